"""Deterministic stand-ins for models; they only look at the prompt."""

from __future__ import annotations

import re

_ANSWER = re.compile(r"Correct answer: (.*)\n\nJudgement:\n\Z", re.S)
_OUTPUT = re.compile(r'\nOutput: """(.*)"""\n\nCorrect answer: ', re.S)


def make_containing_judge():
    """Judges correct when the answer occurs in the output."""

    def judge(prompts, config):
        results = []
        for prompt in prompts:
            answer = _ANSWER.search(prompt).group(1)
            output = _OUTPUT.search(prompt).group(1)
            text = "[Correct]" if answer in output else "[Incorrect]"
            results.append([{"text": text, "tokens_used": len(text), "finish_reason": "stop"}])
        return results

    return judge


def make_rejecting_judge():
    """Judges everything incorrect."""
    return lambda prompts, config: [
        [{"text": "[Incorrect]", "tokens_used": 1, "finish_reason": "stop"}] for _ in prompts
    ]


def make_failing_judge():
    """Fails when it is called."""

    def judge(prompts, config):
        raise RuntimeError("the judge is gone")

    return judge


def make_mixed_judge():
    """As the judge above with plain labels, but bracketed ones for outputs with a key ending in 7."""

    def judge(prompts, config):
        results = []
        for prompt in prompts:
            output = _OUTPUT.search(prompt).group(1)
            text = "Correct" if _ANSWER.search(prompt).group(1) in output else "Incorrect"
            text = f"[{text}]" if output.split(" ")[2].endswith("7") else text
            results.append([{"text": text, "tokens_used": 1, "finish_reason": "stop"}])
        return results

    return judge


def make_echo_model():
    """Answers with the last message, shortened for odd generations."""

    def model(prompts, config):
        results = []
        for prompt in prompts:
            text = prompt if isinstance(prompt, str) else prompt[-1]["content"]
            results.append(
                [
                    {
                        "text": f"{i}: {text if i % 2 == 0 else text[:10]}",
                        "tokens_used": len(text) if i % 2 == 0 else 10,
                        "saw_eos": i % 2 == 1,
                    }
                    for i in range(config.n)
                ]
            )
        return results

    return model
