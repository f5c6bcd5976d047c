from __future__ import annotations

import hashlib
import json
import random

import pytest

from tesserae.llm import bpe
from tesserae.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id bigint, text string, n_tokens string, ids string"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary())


def texts() -> list[str]:
    rng = random.Random(1)
    letters = "abcdeABC  \n\t'st're'll012,.!<|endoftext|>éÉñßΣΑΣİıǺ가 \x85\x1c\x1f\u200b\u3000中文🙂ﬁǅ\xa0e\u0301"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ["<|endoftext|>a<|startoftext|> b", "aaaaaaaaa" * 9, "", " \n", "don't WE'LL it's 's", "x" * 70000]


def test_as_the_library_does(library):
    with open(vocabulary(), encoding="utf-8") as f:
        merger = bpe.Merger(f.read())
    for text, (n, ids, decoded) in zip(texts(), merger.encode(texts()), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert (n, ids) == (len(want), " ".join(map(str, want))), repr(text)
        assert decoded == library.decode(want, skip_special_tokens=False), repr(text)


def test_query_and_round_trip(spark, library):
    some = texts()[:300]
    rows = [(i, t, "x", "y") for i, t in enumerate(some)] + [(None, "null id", None, None), (7, None, None, None), (7, None, None, None)]
    got = bpe.encoded(spark.createDataFrame(rows, SCHEMA).repartition(3), vocabulary(), with_ids=True, with_text=True).collect()
    assert len(got) == len(rows)
    with open(vocabulary(), encoding="utf-8") as f:
        spec = f.read()
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] not in (7, None)}
    for i, t in enumerate(some):
        if i == 7:
            continue
        want = library.encode(t, add_special_tokens=False).ids
        r = by_id[i]
        assert r["token_ids"] == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r["decoded"] == bpe.decode(spec, r["token_ids"])
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert sum(r["n_tokens"] == 0 for r in got if r["doc_id"] == 7) >= 2
    assert bpe.encoded(spark.createDataFrame([], SCHEMA), vocabulary()).collect() == []


def test_a_merge_may_lead_back_to_an_earlier_rank():
    """abc comes of two merges, the later of which makes a pair of lower rank active again."""
    chars = bpe.byte_chars()
    merges = [("a", "b"), ("ab", "c"), ("abc", "d"), ("b", "c"), ("a", "bc"), ("d", "d</w>"), ("a", "a"), ("aa", "a")]
    vocab: dict[str, int] = {}
    for t in [*chars, *(c + "</w>" for c in chars), *(x + y for x, y in merges)]:
        vocab.setdefault(t, len(vocab))
    spec = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": {"type": "NFC"}, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "\\S+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}, "post_processor": None, "decoder": None, "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": [list(m) for m in merges]}}
    library, merger = tokenizers.Tokenizer.from_str(json.dumps(spec)), bpe.Merger(json.dumps(spec))
    assert merger.back.any()
    rng = random.Random(2)
    for _ in range(3000):
        word = "".join(rng.choice("aabcd") for _ in range(rng.randint(1, 12)))
        flat, ends = merger.merged([word.encode()])
        assert flat == library.encode(word).ids and ends == [len(flat)], word


@pytest.mark.parametrize("change", ["normalizer", "split", "added"])
def test_files_with_other_rules(change):
    """A normalizer, split or added tokens other than those handled here go through the library; white space may then be part of a pre-token."""
    with open(vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    if change == "normalizer":
        spec["normalizer"] = {"type": "NFC"}
    elif change == "split":
        spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": " ?[a-z]+|[^a-z ]+"}
    else:
        spec["added_tokens"] += [{"id": 49408, "content": "[stop]", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}]
    library, merger = tokenizers.Tokenizer.from_str(json.dumps(spec)), bpe.Merger(json.dumps(spec))
    assert not merger.direct
    some = texts()[:400] + ["a bc  de[stop]f", "xy 12 ab"]
    for text, (n, ids, _) in zip(some, merger.encode(some), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert (n, ids) == (len(want), " ".join(map(str, want))), repr(text)


def test_other_models_are_refused():
    with open(vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    for where, key, value in (("model", "unk_token", "<|endoftext|>"), (None, "pre_tokenizer", {"type": "Whitespace"}), ("added", "normalized", True)):
        other = json.loads(json.dumps(spec))
        (other["added_tokens"][0] if where == "added" else other[where] if where else other)[key] = value
        with pytest.raises(ValueError):
            bpe.Merger(json.dumps(other))
