"""BPE by speculation: greedy longest matches are proposed, adjacent pairs verified, and only failing words merged.

A text is cut into pre-tokens. For the words a task has not seen, an automaton proposes the longest vocabulary entry at
each place. A proposal is the true encoding if each of its tokens encodes to itself and each adjacent pair stays a pair
when its bytes are encoded; pairs are tested together with numpy, by undoing merges at the border from the latest on
and looking for one that would have come first. Words that fail are merged exactly, by rank. Encodings of words are
kept in a worker up to KEEP words, then the later half is forgotten. Decoding turns each id into its bytes and the bytes into text.

Null and empty texts have no ids. Special strings in a text are one id each. Repeated rows get a row each. Very long texts
are encoded whole, one at a time; without documents the result is empty. Other columns pass as they are; those that are
named like a new one, in any case, are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import lean_session, text_or_empty

KEEP = 300_000
#: White space as the byte-level pre-tokeniser has it, and its pattern; PLAIN equals it where no letter numbers occur.
SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^{SPACE}\w]|_)+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
ODD = regex.compile(r"[\p{Nl}\p{No}]")


def pretokens(text: str) -> list[str]:
    return PLAIN.findall(text) if text.isascii() or not ODD.search(text) else PATTERN.findall(text)


def specials(described: dict) -> dict[str, int]:
    """The special strings of a tokenizer's file and their ids. Only byte-level files with the usual pattern are read."""
    kind = described.get("pre_tokenizer") or {}
    if kind.get("type") != "ByteLevel" or kind.get("use_regex") is False or kind.get("add_prefix_space") or described.get("normalizer"):
        raise ValueError("not a byte-level tokenizer with the usual pattern")
    return {t["content"]: t["id"] for t in described.get("added_tokens", [])}


def cutter(special: Iterable[str]) -> Callable[[str], list[str]]:
    """Cuts a text into pre-tokens and special strings."""
    known = sorted(special, key=len, reverse=True)
    if not known:
        return pretokens
    mark = re.compile("(" + "|".join(map(re.escape, known)) + ")")

    def cut(text: str) -> list[str]:
        if not any(s in text for s in known):
            return pretokens(text)
        return [w for k, part in enumerate(mark.split(text)) for w in ([part] if k % 2 else pretokens(part))]

    return cut


def text_runs(column: pa.Array, size: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of runs of texts of about size bytes, or one longer text."""
    length = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    end = np.cumsum(length)
    at = 0
    while at < len(length):
        stop = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + size, side="right")))
        yield at, stop
        at = stop


def byte_of_char() -> dict[str, int]:
    """The byte for each character that byte-level vocabularies use: printable bytes stand for themselves, others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class SpeculativeBpe:
    def __init__(self, described: str):
        import ahocorasick

        x = json.loads(described)
        to_byte = byte_of_char()
        raw = lambda s: bytes(to_byte[c] for c in s)
        vocab = {raw(k): v for k, v in x["model"]["vocab"].items()}
        self.special = specials(x)
        self.cut = cutter(self.special)
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * size
        for k, v in vocab.items():
            self.bytes[v] = k
        for k, v in self.special.items():
            self.bytes[v] = k.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in x["model"]["merges"]]
        left = np.array([vocab[raw(a)] for a, _ in merges], np.int64)
        right = np.array([vocab[raw(b)] for _, b in merges], np.int64)
        made = np.array([vocab[raw(a + b)] for a, b in merges], np.int64)
        self.size = size
        self.made = made
        code = left * size + right
        order = np.argsort(code)
        self.code, self.code_rank = code[order], order
        self.of_byte = [vocab[bytes([b])] for b in range(256)]
        # The merge that makes a token: its rank and parts. Single bytes come before all merges.
        self.birth, self.left, self.right = np.full(size, -1), np.arange(size), np.arange(size)
        self.birth[made[::-1]], self.left[made[::-1]], self.right[made[::-1]] = np.arange(len(merges))[::-1], left[::-1], right[::-1]
        self.auto = ahocorasick.Automaton()
        for (k, v), own in zip(vocab.items(), self.merged_together(list(vocab))):
            if len(k) == 1 or own == [v]:  # else a proposal with it is never right
                self.auto.add_word(k.decode("latin-1"), v)
        self.auto.make_automaton()
        #: For each word its ids joined by commas, and the bytes that they decode to.
        self.ids: dict[str, str] = {}
        self.raw: dict[str, bytes] = {}

    def merged_together(self, words: list[bytes]) -> list[list[int]]:
        """Exact merging of many words at once: each round merges, in every word, all places of its pair of least rank."""
        flat = np.array(self.of_byte)[np.frombuffer(b"".join(words), np.uint8)]
        of = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_ids, done_of = [], []
        none = len(self.code_rank)
        while len(flat):
            code = flat[:-1] * self.size + flat[1:]
            place = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
            rank = np.full(len(flat), none)
            rank[:-1] = np.where((self.code[place] == code) & (of[1:] == of[:-1]), self.code_rank[place], none)
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            length = np.diff(np.append(first, len(of)))
            least = np.repeat(np.minimum.reduceat(rank, first), length)
            over = least == none
            done_ids.append(flat[over])
            done_of.append(of[over])
            flat, of, rank, least = flat[~over], of[~over], rank[~over], least[~over]
            if not len(flat):
                break
            hit = rank == least
            # Of overlapping places (a run of one token), every second one merges, from the left.
            start = hit & ~np.concatenate(([False], hit[:-1]))
            at = np.arange(len(hit))
            from_start = at - np.maximum.accumulate(np.where(start, at, -1))
            hit &= from_start % 2 == 0
            flat = np.where(hit, self.made[np.minimum(rank, none - 1)], flat)
            keep = ~np.concatenate(([False], hit[:-1]))
            flat, of = flat[keep], of[keep]
        ids, of = np.concatenate(done_ids), np.concatenate(done_of)
        order = np.argsort(of, kind="stable")
        ids, cut = ids[order].tolist(), np.searchsorted(of[order], np.arange(len(words) + 1)).tolist()
        return [ids[a:b] for a, b in zip(cut, cut[1:])]

    def stays(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of tokens, whether the bytes of both encode to just the two.

        The border is followed back in time: of the two tokens that meet at it, the later made is taken apart, and a
        merge across the border breaks the pair if its rank is below that of the merge that was undone last.
        """
        out = np.ones(len(a), bool)
        at = np.arange(len(a))
        limit = np.full(len(a), 2 * self.size)
        strict = np.zeros(len(a), bool)  # at equal rank the left merge comes first
        while len(at):
            code = a * self.size + b
            place = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
            rank = np.where(self.code[place] == code, self.code_rank[place], 4 * self.size)
            broken = (rank < limit) | ((rank == limit) & strict)
            out[at[broken]] = False
            go = ~broken & ((self.birth[a] >= 0) | (self.birth[b] >= 0))
            at, a, b = at[go], a[go], b[go]
            open_left = self.birth[a] > self.birth[b]
            limit = np.where(open_left, self.birth[a], self.birth[b])
            strict = ~open_left
            a, b = np.where(open_left, self.right[a], a), np.where(open_left, b, self.left[b])
        return out

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the longest matches over all words, and the word that each is in."""
        ends, ids = [], []
        for end, v in self.auto.iter_long("\u0100".join(w.decode("latin-1") for w in words)):
            ends.append(end)
            ids.append(v)
        bound = np.cumsum([len(w) + 1 for w in words])
        return np.array(ids, np.int64), np.searchsorted(bound, np.array(ends, np.int64), side="right")

    def learn(self, words: list[str]) -> int:
        """Encodes words into ids and raw; how many of them needed exact merging."""
        raw = [w.encode("utf-8", "replace") for w in words]
        ids, of = self.propose(raw)
        inner = np.flatnonzero(of[1:] == of[:-1])
        pair, inverse = np.unique(ids[inner] * self.size + ids[inner + 1], return_inverse=True)
        bad = ~self.stays(pair // self.size, pair % self.size)[inverse]
        failed = np.zeros(len(words), bool)
        failed[of[inner[bad]]] = True
        cut = np.searchsorted(of, np.arange(len(words) + 1)).tolist()
        ids = ids.tolist()
        wrong = np.flatnonzero(failed).tolist()
        exact = dict(zip(wrong, self.merged_together([raw[i] for i in wrong]))) if wrong else {}
        for i, w in enumerate(words):
            own = exact[i] if i in exact else ids[cut[i] : cut[i + 1]]
            self.ids[w], self.raw[w] = ",".join(map(str, own)), self.decoded(own)
        return int(failed.sum())

    def decoded(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[i] for i in ids])

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """For each text the number of ids, the ids joined by commas, and the bytes that they decode to."""
        for special, i in self.special.items():
            self.ids[special], self.raw[special] = str(i), self.bytes[i]
        cut = [self.cut(t) for t in texts]
        new = set(filterfalse(self.ids.__contains__, chain.from_iterable(cut)))
        if len(self.ids) + len(new) > KEEP:
            first = list(self.ids)[: KEEP // 2]  # the words learnt first, so the frequent ones
            self.ids, self.raw = {w: self.ids[w] for w in first}, {w: self.raw[w] for w in first}
            new = set(filterfalse(self.ids.__contains__, chain.from_iterable(cut)))
        if new:
            self.learn(list(new))
        for words in cut:
            ids = ",".join(map(self.ids.__getitem__, words))
            yield ids.count(",") + bool(ids), ids, b"".join(map(self.raw.__getitem__, words))


_loaded: dict[str, SpeculativeBpe] = {}


def coder(described: str) -> SpeculativeBpe:
    """One coder for each worker process and vocabulary."""
    key = hashlib.sha256(described.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = SpeculativeBpe(described)
    return _loaded[key]


def encoded(docs: DataFrame, tokenizer_file: str, schema: str, columns: Callable[[list[tuple[int, str, bytes]]], list[pa.Array]]) -> DataFrame:
    """docs, whose last column is the text, with the columns in its place that columns() makes of (n, ids, decoded). Other columns stay as they are."""
    lean_session(docs.sparkSession)
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a tokenizer's file, of fixed size
    names = StructType.fromDDL(schema).names
    kept = StructType(docs.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(shared.value)
        for batch in batches:
            *other, text = batch.columns
            for a, b in text_runs(text):
                new = columns(list(c.encode(text[a:b].to_pylist())))
                yield pa.RecordBatch.from_arrays([*(x[a:b] for x in other), *new], [*batch.schema.names[:-1], *names])

    return docs.mapInArrow(run, StructType(kept.fields + StructType.fromDDL(schema).fields))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def round_trip(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    def columns(found: list[tuple[int, str, bytes]]) -> list[pa.Array]:
        return [pa.array([n for n, _, _ in found], pa.int64()), pa.array([sha(ids.encode()) for _, ids, _ in found], pa.string()), pa.array([sha(raw.decode("utf-8", "replace").encode()) for _, _, raw in found], pa.string())]

    return encoded(rows, tokenizer_file, "n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


def encode_documents(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """The documents with their ids: every other column, then text, token_ids and n_tokens, which replace columns of these names in any case."""
    rows = docs.withColumn("text", text_or_empty())
    rows = rows.select(*[rows[f"`{c}`"] for c in rows.columns if c.lower() not in ("text", "token_ids", "n_tokens")], "text")

    def columns(found: list[tuple[int, str, bytes]]) -> list[pa.Array]:
        ids = [np.array(ids.split(",") if ids else [], np.int32) for _, ids, _ in found]
        return [pa.array([raw.decode("utf-8", "replace") for _, _, raw in found], pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array([n for n, _, _ in found], pa.int64())]

    # Names with dots are not for mapInArrow.
    plain = rows.toDF(*[f"c{i}" for i in range(len(rows.columns) - 1)], "text")
    return encoded(plain, tokenizer_file, "text string, token_ids array<int>, n_tokens long", columns).toDF(*rows.columns, "token_ids", "n_tokens")
