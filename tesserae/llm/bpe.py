"""BPE encoding and decoding with a pair occurrence index.

The distinct pieces (pre-tokens) of a part of a partition are laid out as one sequence of symbols. An index maps each mergeable pair to all its positions; the lowest rank that has positions is applied to all of them at once, and only the pairs beside the merged places enter the index again. Texts are then put together from their pieces. No shuffle is needed, and memory is bounded by the size of a part.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm.common import small_batches

#: Characters of texts that are looked at together, and pieces that a worker keeps between parts.
PART_CHARS, KEPT_CHUNKS = 4_000_000, 200_000
#: The normalizer and the pre-tokenizer whose work on plain text is done here directly. For others the library's are used, on whole texts.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: What a model must not have: its pieces would not be those of a plain byte-level BPE.
PLAIN_MODEL = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
ODD_SPACE = re.compile("[\x1c-\x1f]")
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Chunks of ASCII and of composed Latin letters, for which the library's normalizer only lowers the case; of these, letters and the pre-tokens.
PLAIN = re.compile("[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]*")
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\u017f]+|[0-9]|[^\t-\r a-z0-9\xdf-\xf6\xf8-\u017f]+")


@lru_cache(1)
def byte_chars() -> list[str]:
    """The usual printable stand-ins of the 256 bytes: printable Latin-1 characters for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(n)
            n += 1
    return [out[b] for b in range(256)]


class Merger:
    """Applies the merges of one vocabulary."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        model, split = parsed["model"], parsed["pre_tokenizer"]
        last = split["pretokenizers"][-1] if split and split["type"] == "Sequence" else split
        odd = [k for k, v in PLAIN_MODEL.items() if model.get(k, v) != v]
        odd += [t["content"] for t in parsed["added_tokens"] if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]]
        if model["type"] != "BPE" or not last or last["type"] != "ByteLevel" or odd or parsed["decoder"] or parsed["post_processor"]:
            raise ValueError(f"not a plain byte-level BPE: {odd or 'model, pre-tokenizer, decoder or post-processor'}")
        added = [t["content"] for t in parsed["added_tokens"]]
        #: How all added tokens begin; a chunk without that has none.
        self.mark: str = os.path.commonprefix(added)
        #: Whether pre-tokens can be found here and never hold white space.
        self.direct = parsed["normalizer"] == NORMALIZER and split == {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]} and bool(self.mark or not added)
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.names = {i: t for t, i in self.vocab.items()}
        library = Tokenizer.from_str(spec)
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.added = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        self.names |= {i: t for t, i in self.added.items()}
        self.numbers = {i: str(i) for i in self.names}
        self.added_at = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.base = 1 + max(self.vocab.values())
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int32)
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        keys = left * self.base + right
        self.rank_at = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_at]
        lowest = np.full(self.base, len(pairs), np.int64)  # of the ranks that use a symbol
        np.minimum.at(lowest, left, np.arange(len(pairs)))
        np.minimum.at(lowest, right, np.arange(len(pairs)))
        #: Merges whose product can take part in an earlier one: of these, one place of a piece is merged at a time.
        self.back = lowest[self.made] <= np.arange(len(pairs))
        chars = byte_chars()
        self.inner = [self.vocab[c] for c in chars]
        self.final = [self.vocab[c + self.suffix] for c in chars]
        self.of_char = {c: b for b, c in enumerate(chars)}
        self.kept: dict[str, tuple[int, str, str]] = {}
        self.known: dict[str | int, tuple[int, str, str]] = {}
        self.forget()

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, -1 where there is no merge."""
        want = a.astype(np.int64) * self.base + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.rank_at[at], -1)

    def merged(self, pieces: list[bytes]) -> tuple[list[int], list[int]]:
        """The symbols of all pieces (none empty) after all merges, in one list, and where each piece's end."""
        lens = np.array([len(p) for p in pieces], np.int32)
        ends = np.cumsum(lens, dtype=np.int32)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        sym = np.array(self.inner, np.int32)[flat]
        sym[ends - 1] = np.array(self.final, np.int32)[flat[ends - 1]]
        of = np.repeat(np.arange(len(pieces), dtype=np.int32), lens)
        n = len(sym)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1
        before[ends - lens] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Put pairs that begin at these places into the index."""
            if not len(at):
                return
            rank = self.ranks(sym[at], sym[after[at]])
            ok = rank >= 0
            at, rank = at[ok], rank[ok]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, places in zip(rank[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True):
                if r in index:
                    index[r].append(places)
                else:
                    index[r] = [places]
                    heapq.heappush(active, r)

        every = np.flatnonzero(after >= 0).astype(np.int32)
        for part in np.array_split(every, 1 + len(every) // 250_000):
            enter(part)
        del every, flat, ends, lens
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            at = at[(sym[at] == a) & (after[at] >= 0)]
            at = at[sym[after[at]] == b]
            if not len(at):
                continue
            if a == b and len(at) > 1:  # of overlapping places every other one, from the left
                first = np.r_[True, after[at[:-1]] != at[1:]]
                run = np.flatnonzero(first)
                at = at[(np.arange(len(at)) - run[np.cumsum(first) - 1]) % 2 == 0]
            if self.back[r]:
                first = np.r_[True, of[at[1:]] != of[at[:-1]]]
                if not first.all():
                    index[r] = [at[~first]]
                    heapq.heappush(active, r)
                    at = at[first]
            gone = after[at]
            sym[at] = self.made[r]
            sym[gone] = -1
            follow = after[gone]
            after[at] = follow
            has = follow >= 0
            before[follow[has]] = at[has]
            prev = before[at]
            enter(np.unique(np.concatenate([prev[prev >= 0], at[has]])))
        alive = sym >= 0
        return sym[alive].tolist(), np.cumsum(np.bincount(of[alive], minlength=len(pieces))).tolist()

    def plain(self, chunk: str) -> bool:
        """Whether the chunk is plain text without added tokens, whose pre-tokens can be found here."""
        return self.direct and PLAIN.fullmatch(chunk) is not None and not (self.mark and self.mark in chunk)

    def pieces(self, chunk: str) -> list[str | int]:
        """The pre-tokens of a text without white space; added tokens as ids."""
        if self.plain(chunk):
            return PIECE.findall(chunk.lower())
        out: list[str | int] = []
        for part in self.added_at.split(chunk) if self.added_at else [chunk]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out += [bytes([self.of_char[c] for c in p]).decode("utf-8", "surrogatepass") for p, _ in self.split(self.normal(part)) if p]
        return out

    def learn(self, chunks: set[str]) -> None:
        """Encode chunks (texts without white space) into kept, and their pre-tokens into known: number of tokens, ids and token names, each joined by a space."""
        if len(self.kept) > KEPT_CHUNKS:
            self.kept = {}
        if len(self.known) > KEPT_CHUNKS:
            self.known = {i: (1, str(i), t) for t, i in self.added.items()}
        kept, known, plain, split = self.kept, self.known, self.plain, PIECE.findall
        new = [c for c in chunks if c not in kept]
        whole, parts = [], []  # chunks that are one pre-token, and the others with theirs
        for c in new:
            if plain(c):
                low = c.lower()
                if low.isalpha():
                    whole.append((c, low))
                else:
                    parts.append((c, split(low)))
            else:
                parts.append((c, self.pieces(c)))
        wanted = {p for _, p in whole}
        wanted.update(*[ps for _, ps in parts])
        fresh = [p for p in wanted if p not in known]
        if fresh:
            flat, ends = self.merged([p.encode("utf-8", "surrogatepass") for p in fresh])
            ids, names = [self.numbers[i] for i in flat], [self.names[i] for i in flat]
            start = 0
            for p, end in zip(fresh, ends, strict=True):
                known[p] = (1, ids[start], names[start]) if end == start + 1 else (end - start, " ".join(ids[start:end]), " ".join(names[start:end]))
                start = end
        for c, p in whole:
            kept[c] = known[p]
        for c, ps in parts:
            got = [known[p] for p in ps]
            kept[c] = (sum([x[0] for x in got]), " ".join([x[1] for x in got]), " ".join([x[2] for x in got]))

    def forget(self) -> None:
        self.kept, self.known = {}, {i: (1, str(i), t) for t, i in self.added.items()}

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text its number of tokens, its ids and its decoded text."""
        if self.direct:
            words = [SPACE.split(t) if ODD_SPACE.search(t) else t.split() for t in texts]
        else:  # pre-tokens may hold white space: a text is one chunk, and chunks seldom repeat
            self.kept, words = {}, [[t] for t in texts]
        self.learn({w for ws in words for w in ws if w})
        kept = self.kept
        for ws in words:
            got = [kept[w] for w in ws if w]
            counts, ids, names = zip(*got, strict=True) if got else ((), (), ())
            if 0 in counts:  # chunks that the normalizer leaves nothing of
                counts, ids, names = zip(*[x for x in got if x[0]], strict=True) if any(counts) else ((), (), ())
            yield sum(counts), " ".join(ids), " ".join(names)


_mergers: dict[str, Merger] = {}


def merger(spec: str) -> Merger:
    """One per worker process, with what it has learnt."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _mergers:
        _mergers.clear()
        _mergers[key] = Merger(spec)
    return _mergers[key]


def decode(spec: str, ids: list[int]) -> str:
    """As the library's decode(ids, skip_special_tokens=False) for a vocabulary without a decoder: known names joined by a space."""
    names = merger(spec).names
    return " ".join(names[i] for i in ids if i in names)


def encoded(docs: DataFrame, vocab_path: str, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Tokens of whole texts: doc_id, n_tokens, ids_sha256, decoded_sha256, and on request token_ids (array of int) and decoded (text).

    docs: doc_id and text; other columns are ignored. vocab_path: a file of the tokenizers library with a byte-level BPE model and neither decoder nor post-processor (others are refused); it is read on the driver and sent along. A null or blank text has no tokens and decodes to the empty text. One row for each row, repeated ones and null ids too.
    """
    small_batches(docs.sparkSession)
    with open(vocab_path, encoding="utf-8") as f:
        spec = f.read()
    sent = docs.sparkSession.sparkContext.broadcast(spec)  # a file of fixed size
    # ids and texts take room of their own
    part_chars = PART_CHARS // 8 if with_ids or with_text else PART_CHARS
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = merger(sent.value)
        gc.disable()  # no cycles come up here, and looking for some among so many small objects takes long
        try:
            yield from encoded_batches(bpe, batches)
        finally:
            bpe.forget()
            gc.enable()
            pa.default_memory_pool().release_unused()

    def encoded_batches(bpe: Merger, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            start = 0
            while start < batch.num_rows:
                part, chars = [], 0
                while start + len(part) < batch.num_rows and (not part or chars < part_chars):
                    text = texts[start + len(part)].as_py() or ""
                    part.append(text)
                    chars += len(text)
                cols: list[list] = [[], [], [], [], []]
                for n, i, d in bpe.encode(part):
                    cols[0].append(n)
                    cols[1].append(hashlib.sha256(i.encode()).hexdigest())
                    cols[2].append(hashlib.sha256(d.encode()).hexdigest())
                    if with_ids:
                        cols[3].append(i)
                    if with_text:
                        cols[4].append(d)
                out = [ids.slice(start, len(part)), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    flat = np.fromstring(" ".join(filter(None, cols[3])), np.int32, sep=" ")
                    ends = np.cumsum([0, *cols[0]], dtype=np.int32)
                    out, names = [*out, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [*names, "token_ids"]
                if with_text:
                    out, names = [*out, pa.array(cols[4], pa.string())], [*names, "decoded"]
                yield pa.RecordBatch.from_arrays(out, names)
                start += len(part)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)
