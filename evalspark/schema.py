"""Column layout of the tables that the jobs hand to each other."""

from __future__ import annotations

from dataclasses import dataclass

# One benchmark question, whatever the source file looked like.
SAMPLE_COLUMNS = ("dataset", "split", "id", "problem", "answer", "metadata")

# One model output; several share an id when a prompt is sampled more than once.
RESPONSE_KEYS = ("dataset", "id", "generation_id")

RESPONSE_SCHEMA = (
    "run_id string, model string, dataset string, split string, id string, "
    "generation_id int, problem string, answer string, model_output string, "
    "tokens_used double, finish_reason string"
)

GENERATIONS_TYPE = (
    "array<struct<text:string,tokens_used:bigint,finish_reason:string,saw_eos:boolean>>"
)

JUDGE_RECORD_SCHEMA = (
    "question string, llm_output string, correct_answer string, setting string, "
    "model_name string, dataset string"
)


@dataclass(frozen=True)
class GenerationConfig:
    """Sampling parameters passed unchanged to the user's model callable."""

    # Names and defaults of the parameters.
    temperature: float = 0.7
    top_p: float = 0.9
    top_k: int = 50
    max_tokens: int = 2048
    stop_sequences: tuple[str, ...] | None = None
    n: int = 1
    seed: int | None = None
