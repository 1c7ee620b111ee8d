"""Alignment of two tokenizers over a corpus: minimal common groups and counted links.

A text's tokens under A and under B tile the same bytes. Tokens that overlap are joined by an edge; union-find over this
bipartite graph gives components, and these are exactly the minimal groups between neighbouring common ends. Members of a
component whose byte ranges end together are linked; links are counted for each pair of ids over all documents.

Two linked tokens end at one byte, so one is a suffix of the other. That bounds the pairs that can occur by the total
length of both vocabularies' tokens, whatever the corpus: some 10^5 pairs, numbered alike in every task. Tasks count them
in an array and send only sums; the finished counts return to the tasks as an array of that bounded size.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_slices, small_batches
from .packing import BYTE_LETTERS

#: Both tokenizers begin a new token at a single space between two visible characters, so texts are cut there and pieces seen before are remembered.
CUT = re.compile(r"(?<=\S) (?=\S)")
MEMORY_PIECES = 400_000
MEMORY_CHARS = 48
#: Characters of new pieces that are tokenised at once.
RUN_CHARS = 1 << 15
#: Stands for tokens that spell nothing; no text holds this byte.
NO_BYTES = b"\xff"


class Vocabularies:
    """The bytes of both tokenizers' tokens, and the numbered pairs of ids that can end together."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {chr(c): b for b, c in BYTE_LETTERS.items()} | {chr(b): b for b in range(256) if b not in BYTE_LETTERS}
        self.bytes_a = [NO_BYTES] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            if all(c in byte_of for c in token):
                self.bytes_a[i] = bytes(byte_of[c] for c in token)
        self.bytes_b = [self._bytes_b(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.pairs = self._pairs()
        self.pair_b = self.pairs % len(self.bytes_b)
        self.names = list(map(str, range(max(len(self.bytes_a), len(self.bytes_b)))))
        self.signed = [n + sign for sign in ",|;" for n in self.names]

    def _bytes_b(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return NO_BYTES if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace("▁", " ").encode()

    def _pairs(self) -> np.ndarray:
        """a * size of B + b of all pairs of which one is a suffix of the other, ascending."""
        at_a, at_b, n = defaultdict(list), defaultdict(list), len(self.bytes_b)
        for at, tokens in ((at_a, self.bytes_a), (at_b, self.bytes_b)):
            for i, t in enumerate(tokens):
                at[t].append(i)
        found = {i * n + j for i, t in enumerate(self.bytes_a) for k in range(len(t)) for j in at_b.get(t[k:], ())}
        found |= {i * n + j for j, t in enumerate(self.bytes_b) for k in range(1, len(t)) for i in at_a.get(t[k:], ())}
        return np.sort(np.fromiter(found, np.int64, len(found)))


@functools.lru_cache(maxsize=2)
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    return Vocabularies(path_a, path_b)


def union_find(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' components, for edges a-b: roots are hooked to smaller roots, then all paths are compressed."""
    parent = np.arange(n)
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def components(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The component of each A and of each B token, numbered in order; the tokens tile the same bytes and are given by their ends."""
    marks = np.sort(np.concatenate([ends_a, ends_b]))
    marks = marks[np.append(True, marks[1:] != marks[:-1])]
    starts = np.concatenate([[0], marks[:-1]])  # each stretch between marks lies in one token of A and one of B: an edge
    root = union_find(len(ends_a) + len(ends_b), np.searchsorted(ends_a, starts, "right"), len(ends_a) + np.searchsorted(ends_b, starts, "right"))
    number = (np.cumsum(root == np.arange(len(root))) - 1)[root]  # a root is its component's first token of A
    return number[: len(ends_a)], number[len(ends_a) :]


class Aligner:
    """Aligns texts; what was found for short pieces is remembered."""

    def __init__(self, path_a: str, path_b: str):
        self.v = vocabularies(path_a, path_b)
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.text: list[str] = []
        self.table = [np.empty((0, 5), np.int64)]  # tokens of A, of B, groups, links, whether the bytes are those of the text
        self.flat = [np.empty(0, np.int64)]
        self.long = False

    def _keep(self, pieces: list[str], groups: list[str], table: np.ndarray, pairs: np.ndarray) -> bool:
        self.code.update(zip(pieces, range(len(self.code), len(self.code) + len(pieces))))
        self.text += groups
        self.table.append(table)
        self.flat.append(pairs)
        return True

    def _add(self, pieces: list[str]) -> bool:
        """Adds pieces tokenised in one go; false if they turn out not to be apart, which a single one always is."""
        text = " " + " ".join(pieces)
        raw = text.encode()
        a, b = self.v.a.encode(text, add_special_tokens=False).ids, self.v.b.encode(text[1:])
        if not b"".join(map(self.v.bytes_a.__getitem__, a)) == raw == b"".join(map(self.v.bytes_b.__getitem__, b)):
            return len(pieces) == 1 and self._keep(pieces, [""], np.zeros((1, 5), np.int64), np.empty(0, np.int64))
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.v.size_a[a]), np.cumsum(self.v.size_b[b])
        ends = np.cumsum([len(p.encode()) + 1 for p in pieces])
        in_a, in_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        if (ends_a[in_a] != ends).any() or (ends_b[in_b] != ends).any():
            return False
        group_a, group_b = components(ends_a, ends_b)
        # A group's ids of A, then those of B, each with the sign that follows it.
        last = lambda g: np.append(g[1:] != g[:-1], True)
        sign = np.concatenate([np.where(last(group_a), len(self.v.names), 0) + a, np.where(last(group_b), 2 * len(self.v.names), 0) + b])
        spelt = list(map(self.v.signed.__getitem__, sign[np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")].tolist()))
        to = in_a + in_b + 2
        groups = ["".join(spelt[x:y]) for x, y in zip([0, *to[:-1].tolist()], to.tolist())]
        # Members of a component that end together are linked.
        other = np.searchsorted(ends_b, ends_a)
        linked = (ends_b[other] == ends_a) & (group_b[other] == group_a)
        pair = np.searchsorted(self.v.pairs, a[linked] * len(self.v.bytes_b) + b[other[linked]])
        reached = np.stack([in_a + 1, in_b + 1, group_a[in_a] + 1, np.searchsorted(ends_a[linked], ends, "right")], 1)
        return self._keep(pieces, groups, np.column_stack([np.diff(reached, axis=0, prepend=0), np.ones(len(pieces), np.int64)]), pair)

    def _learn(self, pieces: list[str]) -> None:
        run, size = [], 0
        for p in pieces:
            if p[0].isspace() or p[-1].isspace() or len(p) > RUN_CHARS:
                self._add([p])
                continue
            run.append(p)
            size += len(p)
            if size > RUN_CHARS:
                self._add_all(run)
                run, size = [], 0
        self._add_all(run)

    def _add_all(self, run: list[str]) -> None:
        if run and not self._add(run):
            half = len(run) // 2
            for some in ([run[:half], run[half:]] if len(run) > 64 else [[p] for p in run]):
                self._add_all(some)

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """For each text its four counts, its groups, and the numbers of its links' pairs in a row. Texts that are null, empty or spelt otherwise have none."""
        if len(self.code) > MEMORY_PIECES:
            self.forget()
        pieces, counts = [], []
        for t in texts:
            own = CUT.split(t) if t else []
            pieces += own
            counts.append(len(own))
        code = np.fromiter(map(self.code.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(code < 0).tolist()
        if missing:
            new = list(dict.fromkeys(pieces[i] for i in missing))
            self.long |= any(len(p) > MEMORY_CHARS for p in new)
            self._learn(new)
            code[missing] = [self.code[pieces[i]] for i in missing]
        self.table, self.flat = [np.concatenate(self.table)], [np.concatenate(self.flat)]
        table = self.table[0]
        ends = np.cumsum(counts)
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])
        if not len(pieces):
            return np.zeros((len(texts), 4), np.int64), [""] * len(texts), np.empty(0, np.int64)
        fine = total(1 - table[code, 4]) == 0
        code_fine = np.repeat(fine, counts)
        own = table[code, :4] * code_fine[:, None]
        n = np.stack([total(own[:, c]) for c in range(4)], 1)
        listed, groups, at = code.tolist(), [], 0
        for k, ok in zip(counts, fine.tolist()):
            groups.append("".join(map(self.text.__getitem__, listed[at : at + k]))[:-1] if ok else "")
            at += k
        sizes = own[:, 3]
        starts = (np.cumsum(table[:, 3]) - table[:, 3])[code]
        to = np.cumsum(sizes)
        links = self.flat[0][np.repeat(starts - (to - sizes), sizes) + np.arange(int(to[-1]))]
        if self.long:  # long pieces are not worth their memory
            self.forget()
        return n, groups, links


def align_batches(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, with_groups: bool) -> Iterator[pa.RecordBatch]:
    """A row for each text, and at the task's end a row for each pair of ids linked in it."""
    tool = Aligner(path_a, path_b)
    seen = np.zeros(len(tool.v.pairs), np.int64)
    names = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "pair", "times", *(["groups"] if with_groups else [])]
    kind = pa.null()
    for batch in row_slices(batches):
        kind = batch.column(0).type
        n, groups, links = tool.align(batch.column(1).to_pylist())
        seen += np.bincount(links, minlength=len(seen))
        digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
        offsets = np.concatenate([[0], np.cumsum(n[:, 3])]).astype("i4")
        yield pa.RecordBatch.from_arrays([
            batch.column(0), *(pa.array(n[:, c]) for c in range(4)), pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(links.astype("i4"))),
            *(pa.nulls(len(n), pa.int64()) for _ in range(2)), *([pa.array(groups, pa.string())] if with_groups else []),
        ], names)
    at = np.flatnonzero(seen)
    if len(at):
        m = len(at)
        yield pa.RecordBatch.from_arrays([
            pa.nulls(m, kind), *(pa.nulls(m, pa.int64()) for _ in range(4)), pa.nulls(m, pa.string()), pa.nulls(m, pa.list_(pa.int32())),
            pa.array(tool.v.pairs[at]), pa.array(seen[at]), *([pa.nulls(m, pa.string())] if with_groups else []),
        ], names)


def _judge(batches: Iterator[pa.RecordBatch], times: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        links = batch.column("links")
        flat, ends = links.flatten().to_numpy(), np.concatenate([[0], np.cumsum(links.value_lengths().to_numpy())])
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
        rest = [c for c in batch.schema.names if c != "links"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(total(best[flat].astype(np.int64))), pa.array(total(times[flat]))], [*rest, "n_best", "count_sum"])


class Alignment:
    """Alignment of a corpus: ``documents`` (a row for each row of ``docs``) and ``pairs`` (a_id, b_id, links: the counts over the corpus).

    A document's row: key, n_a, n_b, n_groups, n_links, n_best (links whose pair is the most frequent of its B id, ties
    included), count_sum (the pairs' counts over its links), groups_sha256, and ``groups`` itself if asked for
    (``a1,a2|b1;a3|b2``). Texts that are null or empty, or whose tokens spell other bytes than space + text (such as
    those that hold U+2581), have zeros, '' and no part in the counts. Repeated rows count each for itself; keys may be
    null; other columns are ignored. A text of any length is aligned whole. An empty table gives empty results.

    Texts are tokenised once; the links wait as numbers of pairs in a written table until the counts are known.
    """

    def __init__(self, docs: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id", with_groups: bool = False):
        spark = docs.sparkSession
        small_batches(spark)
        v = vocabularies(path_a, path_b)
        kind = docs.schema[key].dataType.simpleString()
        schema = f"key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<int>, pair long, times long" + (", groups string" if with_groups else "")
        rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(lambda batches: align_batches(batches, path_a, path_b, with_groups), schema)
        rows = materialize(rows, "links")
        counted = materialize(rows.where("pair is not null").groupBy("pair").agg(F.sum("times").alias("times")), "pairs")
        width = len(v.bytes_b)
        self.pairs = counted.select(F.expr(f"pair div {width}").cast("int").alias("a_id"), (F.col("pair") % width).cast("int").alias("b_id"), F.col("times").alias("links"))
        found = counted.toArrow()  # at most len(v.pairs) rows, which the vocabularies bound
        times = np.zeros(len(v.pairs), np.int64)
        times[np.searchsorted(v.pairs, found.column("pair").to_numpy())] = found.column("times").to_numpy()
        top = np.zeros(width, np.int64)
        np.maximum.at(top, v.pair_b, times)
        best = times == top[v.pair_b]
        own = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if with_groups else [])]
        schema = f"key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string" + (", groups string" if with_groups else "") + ", n_best long, count_sum long"
        judged = rows.where("pair is null").select(*own, "links").mapInArrow(lambda batches: _judge(batches, times, best), schema)
        self.documents = judged.withColumnRenamed("key", key)
