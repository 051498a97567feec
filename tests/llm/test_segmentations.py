import math
import subprocess
import sys
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece

from evalspark.llm import segmentations
from evalspark.llm.common import mix64
from llm.samples import CLASHES, documents, edge_rows

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "hello world", "a", "  b\n\nc\r\n", "日本  x <s>", "the then the", "x" * 70, "a▁b", "\x00é́"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def segmentations_of(sampler, library, text):
    """Log probabilities of all segmentations, by enumeration."""
    pieces, normal = sampler.vocabulary.pieces, library.normalize(text)
    out = {}

    def extend(at, ids, weight):
        if at == len(normal):
            out[tuple(ids)] = weight
        for size in range(1, min(16, len(normal) - at) + 1):
            piece = pieces.get(normal[at : at + size])
            if piece:
                extend(at + size, [*ids, piece[1]], weight + piece[0])

    extend(0, [], 0.0)
    total = math.log(sum(map(math.exp, out.values())))
    return {ids: w - total for ids, w in out.items()}


def keys(count, seed=1):
    return mix64(np.arange(count, dtype=np.uint64) + np.uint64(seed << 32))


def lists(sampler, paths):
    ids, offsets = sampler.ids(paths)
    return [tuple(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:])]


def test_distinct_ordered_and_decodable(library):
    sampler, decoder = segmentations.Sampler(PATH, 4), segmentations.Decoder(PATH)
    for text, paths in zip(TEXTS, sampler.sample(TEXTS, keys(len(TEXTS)))):
        found = lists(sampler, paths)
        assert len(set(found)) == len(found)
        values = [p.value for p in paths]
        assert values == sorted(values, reverse=True)
        for ids in found:
            assert library.decode(list(ids)) == library.decode(library.encode(text)) == decoder.text(ids)


def test_probabilities_by_enumeration(library):
    text, count = "then at", 6_000
    sampler = segmentations.Sampler(PATH, 3)
    want = segmentations_of(sampler, library, text)
    first, weights = Counter(), []
    for start in range(0, count, 500):
        found = sampler.sample([text] * 500, keys(500, start + 1))
        for paths, bound in zip(found, sampler.bound):
            ids = lists(sampler, paths)
            assert len(ids) == 3
            assert all(abs(want[i] - p.log_prob) < 1e-9 for i, p in zip(ids, paths))
            assert paths[-1].value >= bound
            first[ids[0]] += 1
            weights.append(sum(math.exp(p.log_prob - segmentations.log_inclusion(p.log_prob, bound)) for p in paths))
    # the first follows the probabilities, and inclusion probabilities make sums unbiased
    assert sum(abs(first[i] / count - math.exp(w)) for i, w in want.items()) / 2 < 0.02
    assert abs(np.mean(weights) - 1) < 0.02


def test_all_segmentations_of_a_short_text(library):
    sampler = segmentations.Sampler(PATH, 50)
    want = segmentations_of(sampler, library, "and")
    (paths,) = sampler.sample(["and"], keys(1))
    assert set(lists(sampler, paths)) == set(want)
    assert sampler.bound == [-math.inf]
    assert segmentations.log_inclusion(paths[-1].log_prob, -math.inf) == 0.0


def test_samples_do_not_depend_on_the_batch(library):
    sampler = segmentations.Sampler(PATH, 2)
    texts, own = ["some words here", "x" * 300 + " \x00 end", "other words there"] * 3, keys(9)
    together = [lists(sampler, paths) for paths in sampler.sample(texts, own)]
    for i, text in enumerate(texts):
        (paths,) = sampler.sample([text], own[i : i + 1])
        assert lists(sampler, paths) == together[i]
        assert all(library.decode(list(ids)) == text for ids in together[i])


def test_table(spark, library):
    rows = edge_rows()
    encoded = segmentations.sample_encodings(documents(spark, rows, clashing=True), PATH, samples=2)
    assert len(encoded.columns) == len(set(encoded.columns)) and set(CLASHES) <= set(encoded.columns)
    got = segmentations.decode_ids(encoded, PATH).collect()
    for r in got:
        assert r["decoded"] == library.decode(library.encode(r["text"] or ""))
        assert library.decode(r["ids"]) == r["decoded"] and r["log_inclusion"] <= 0
    by_row = Counter((r["doc_id"], r["text"]) for r in got)
    rows_in = Counter(r[:2] for r in rows)
    assert all(by_row[k] == n * (2 if (k[1] or "") else 1) for k, n in rows_in.items())
    again = segmentations.sample_encodings(documents(spark, rows[::-1]), PATH, samples=2).collect()
    state = lambda rs: sorted((str(r["doc_id"]), r["sample"], tuple(r["ids"])) for r in rs)
    assert state(again) == state(got)


def test_empty_table(spark):
    empty = segmentations.sample_encodings(documents(spark, []), PATH)
    assert segmentations.decode_ids(empty, PATH).count() == 0


def test_long_words_as_short_ones(library, monkeypatch):
    # the same lattice, whichever way it is laid out
    words = ["▁antidisestablishment", "▁日本語の文字列", "a", "▁\x00\U0001f600x", "▁antidote"]
    nets = []
    for bound in (48, 0):
        monkeypatch.setattr(segmentations, "LONG_WORD", bound)
        sampler = segmentations.Sampler(PATH, 3)
        nets.append(sampler.sample(["".join(words), *words], keys(6)))
    for one, other in zip(*nets):
        assert [len(p.edges) for p in one] == [len(p.edges) for p in other]
        assert np.allclose([p.log_prob for p in one], [p.log_prob for p in other])


def test_text_without_blanks_takes_no_square(library):
    sampler = segmentations.Sampler(PATH, 2)
    text = "".join(chr(0x3041 + i * i % 83) for i in range(100_000))
    urls = " ".join(f"https://example.org/{'path/' * 15}{i}" for i in range(1_000))
    start = time.perf_counter()
    sampler.sample([text], keys(1))
    sampler.sample([urls], keys(1))
    # laid out character by character it took minutes
    assert time.perf_counter() - start < 30


def test_words_of_earlier_texts_stay_in_the_lattice(library, monkeypatch):
    rng = np.random.default_rng(5)
    words = ["then", "thence", "other\n", "\n\n", "日本語", "▁▁x", "", "\x00\U0001f600", "b" * 60]
    texts = [" ".join(rng.choice(words, 12).tolist()) for _ in range(8)]
    sampler = segmentations.Sampler(PATH, 2)
    first = [lists(sampler, p) for p in sampler.sample(texts, keys(8))]
    held = sampler.lattice.count
    assert [lists(sampler, p) for p in sampler.sample(texts[::-1], keys(8)[::-1])] == first[::-1]
    assert sampler.lattice.count == held
    # a full lattice is begun anew
    monkeypatch.setattr(segmentations, "KEPT_EDGES", 0)
    small = segmentations.Sampler(PATH, 2)
    for i in range(8):
        (paths,) = small.sample(texts[i : i + 1], keys(8)[i : i + 1])
        assert lists(small, paths) == first[i]
    assert small.lattice.count < held


def test_texts_of_a_block_of_ids(library):
    decoder = segmentations.Decoder(PATH)
    blank = library.piece_to_id("▁")
    byte = {int(library.id_to_piece(i)[3:5], 16): i for i in range(library.get_piece_size()) if library.is_byte(i)}
    rows = [library.encode(t) for t in TEXTS]
    rows += [None, [], [blank, blank], [library.bos_id(), blank, byte[0x41]], [byte[0xE3], byte[0x41]], [blank], None]
    want = [
        b"".join(decoder.pieces[i] for i in r or []).removeprefix(b" ").decode("utf-8", "replace") for r in rows
    ]
    ids = pa.array(rows, pa.list_(pa.int32()))
    assert decoder.texts(ids).to_pylist() == want
    assert decoder.texts(ids.slice(1, 9)).to_pylist() == want[1:10]
    assert decoder.texts(ids.slice(0, 0)).to_pylist() == []
    assert "\ufffd" in want[len(TEXTS) + 4]


MEMORY = """
import re, sys
sys.path[:0] = sys.argv[2:]
import numpy as np, pyarrow as pa
from evalspark.llm import segmentations

def held():
    return sum(map(int, re.findall(r"Pss_Anon: +(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def most():
    return int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

def batches(sizes):
    rng = np.random.default_rng(3)
    stems = ["".join(map(chr, rng.integers(97, 123, 7))) for _ in range(60_000)]
    for i, size in enumerate(sizes):
        texts = [" ".join(stems[k] for k in rng.integers(0, len(stems), 250)) for _ in range(size)]
        yield pa.RecordBatch.from_arrays([pa.array(range(size)), pa.array(texts)], names=["doc_id", "text"])

encode = segmentations._encoded(sys.argv[1], 2, 1.0, 7, ["doc_id", "text"])
rows = sum(out.num_rows for out in encode(batches([10])))
start, least = held(), most()
rows += sum(out.num_rows for out in encode(batches([1200, 1200])))
print(rows, most() - least, held() - start)
"""


def test_a_worker_holds_little_beside_its_task_and_less_after_it():
    paths = [p for p in sys.path if p]
    done = subprocess.run([sys.executable, "-c", MEMORY, PATH, *paths], capture_output=True, text=True, check=True)
    rows, most, after = map(float, done.stdout.split())
    assert rows == 2 * 2410
    # slices of a megabyte and a lattice twice as large took 178
    assert most < 150
    # of that 134 stayed with the worker
    assert after < 50
