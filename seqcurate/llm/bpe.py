"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

A piece of text has one encoding, and so has each of its prefixes: every prefix has one last token.
An automaton with suffix links over all tokens gives, for each position, the tokens that end there;
a token is the last one of its prefix if it may follow the last token of what stands before it,
that is, if merging would have produced just this pair. One back-pointer per prefix suffices, and
following them from the end gives the ids. Time is in proportion to the matches, whatever the piece.

Pieces are what the vocabulary's own splitting pattern gives; white-space chunks that were encoded
before are remembered in two generations, and what a process remembers is bounded in bytes. The file's added tokens are
cut out first.

Encoding and decoding run in one pass over the texts, piece by piece, so a task holds one set of tables.

Defined cases: a null text has no ids and decodes to an empty text, as has an empty one; ids that
do not form valid UTF-8 decode with replacement characters; an id the vocabulary lacks is refused; given columns
of the names that are added give way to them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqcurate.llm.common import take_over

#: Code points with the White_Space property.
BLANKS = "\t-\r \x85\xa0  -     　"
#: What a process remembers at most: bytes of chunks in each of two generations, pairs and transitions (about 100 bytes each).
CHUNK_BYTES = 80 << 20
PAIRS = 400_000
TRANSITIONS = 100_000
#: What an entry of a dictionary of texts takes besides the characters, in bytes.
ENTRY = 220
#: Characters encoded before their rows are handed on.
PIECE = 1 << 21


def letter_classes(path: str) -> tuple[str, str]:
    """Letters and numbers as ranges of a pattern, as the installed library classes them.

    Unicode versions of pattern libraries differ, so each code point is put between a letter and a
    digit and the library says to which of the two it belongs.
    """
    split = tokenizers.Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    found: tuple[list[int], list[int]] = ([], [])
    points = [c for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000 and not re.match(f"[{BLANKS}]", chr(c))]
    for at in range(0, len(points), 5000):
        part = points[at : at + 5000]
        starts = {span[0] for _, span in split("".join(f" a{chr(c)}1" for c in part))}
        for k, c in enumerate(part):
            if 4 * k + 2 not in starts:
                found[0].append(c)
            elif 4 * k + 3 not in starts:
                found[1].append(c)

    def ranges(own: list[int], ascii_part: str) -> str:
        own_points = np.asarray(own)
        cuts = np.flatnonzero(np.diff(own_points) > 1)
        first, last = np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(own_points) - 1]))
        return ascii_part + "".join(f"{re.escape(chr(own_points[i]))}-{re.escape(chr(own_points[j]))}" for i, j in zip(first, last, strict=True))

    return ranges(found[0], "A-Za-z"), ranges(found[1], "0-9")


def read_vocabulary(path: str) -> dict:
    """What encoding needs of a tokenizer file: token bytes by id, merges, added tokens, letter classes.

    Only byte-level files whose ids are byte tokens and merge results are taken.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
        raise ValueError("not a plain byte-level BPE file")
    if any(a[k] for a in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens with conditions are not supported")
    # Fixed rule of byte-level files: printable bytes stand for themselves, the others for 256, 257, ...
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    tokens = {i: bytes(byte_of[c] for c in t) for t, i in model["vocab"].items() if all(c in byte_of for c in t)}
    id_of = {t: i for i, t in tokens.items()}
    merges = []
    for pair in model["merges"]:
        left, right = (bytes(byte_of[c] for c in t) for t in (pair.split(" ") if isinstance(pair, str) else pair))
        merges.append((id_of[left], id_of[right], id_of[left + right]))
    letters, numbers = letter_classes(path)
    added = {a["content"]: a["id"] for a in spec["added_tokens"]}
    return {"tokens": tokens, "merges": merges, "added": added, "letters": letters, "numbers": numbers}


class Chunks(dict):
    """Ids of chunks as text; the older half is forgotten when both generations are full."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older, self.held = encode, {}, 0

    def __missing__(self, chunk: str) -> str:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.encode(chunk)
        if len(chunk) <= 64:
            self.held += ENTRY + len(chunk) + len(ids)
            if self.held > CHUNK_BYTES:
                self.older = dict(self)
                self.clear()
                self.held = 0
            self[chunk] = ids
        return ids


class SuffixAutomaton(dict):
    """Reads bytes and knows after each the longest token that ends there; suffix links give the shorter ones.

    A state is the longest stretch read last that begins some token. Steps that leave the trie
    follow suffix links once and are then remembered, ``TRANSITIONS`` of them.
    """

    def __init__(self, tokens: dict[bytes, int]):
        super().__init__()
        self.step, self.learned = self, []
        nodes: list[tuple[int, int]] = [(0, 0)]
        for token in tokens:
            at = 0
            for byte in token:
                key = at << 8 | byte
                if key not in self:
                    self[key] = len(nodes)
                    nodes.append((at, byte))
                at = self[key]
        ends = [-1] * len(nodes)
        for token, i in tokens.items():
            at = 0
            for byte in token:
                at = self[at << 8 | byte]
            ends[at] = i
        self.link, self.longest = [0] * len(nodes), ends
        self.length = {i: len(t) for t, i in tokens.items()}
        self.shorter: dict[int, int] = {}
        depth = [0] * len(nodes)
        for node in range(1, len(nodes)):
            depth[node] = depth[nodes[node][0]] + 1
        for node in sorted(range(1, len(nodes)), key=depth.__getitem__):
            parent, byte = nodes[node]
            link = self._down(self.link[parent], byte) if parent else 0
            self.link[node] = link
            if ends[node] >= 0:
                self.shorter[ends[node]] = ends[link]
            else:
                ends[node] = ends[link]

    def _down(self, state: int, byte: int) -> int:
        """The step from a state whose links are known, without remembering it."""
        while (out := self.get(state << 8 | byte)) is None:
            if not state:
                return 0
            state = self.link[state]
        return out

    def __missing__(self, key: int) -> int:
        state, byte = key >> 8, key & 255
        out = self[self.link[state] << 8 | byte] if state else 0
        if len(self.learned) >= TRANSITIONS:
            for old in self.learned:
                del self[old]
            self.learned.clear()
        self[key] = out
        self.learned.append(key)
        return out


class Codec:
    def __init__(self, vocabulary: dict):
        self.tokens: dict[int, bytes] = dict(vocabulary["tokens"])
        self.added: dict[str, int] = vocabulary["added"]
        self.rank = {i: -1 for i in self.tokens}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (left, right, whole) in enumerate(vocabulary["merges"]):
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (left, right), rank
            self.merged.setdefault((left, right), rank)
        self.whole = {t: i for i, t in self.tokens.items() if len(t) == 1 or i in self.parts}
        self.automaton = SuffixAutomaton(self.whole)
        for text, i in self.added.items():
            self.tokens[i] = text.encode()
        self.bytes_of = {str(i): t for i, t in self.tokens.items()}
        letters, numbers = vocabulary["letters"], vocabulary["numbers"]
        self.pieces = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{BLANKS}{letters}{numbers}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
        ).findall
        # A blank belongs to the chunk after it; of other white space before a chunk the last stands alone.
        self.chunks = re.compile(f" ?[^{BLANKS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]").findall
        self.cut_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None
        self.known: dict[int, bool] = {}
        self.memory = Chunks(self._chunk)

    def follows(self, left: int, right: int) -> bool:
        """Whether merging text that ends and starts with these two tokens leaves them as they are.

        Undoes the later of the two merges step by step along the border; if at some step the two
        border parts would have merged before one of them was made, the pair is not stable.
        """
        a, b, limit = left, right, float("inf")
        answer = True
        while True:
            rank = self.merged.get((a, b))
            if rank is not None and rank < limit:
                answer = False
                break
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                break
            # At equal rank the left merge is done first, so the right one is undone first.
            if ra > rb:
                limit, a = ra, self.parts[a][1]
            else:
                # The pair merges before b is made if its rank is not above b's: left goes first.
                limit, b = rb + 1, self.parts[b][0]
        if len(self.known) >= PAIRS:
            self.known.clear()
        self.known[left << 32 | right] = answer
        return answer

    def piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "surrogatepass")
        if (whole := self.whole.get(data)) is not None:  # a token is the last one of the prefix that it is
            return [whole]
        last: list[int] = [-1] * (len(data) + 1)
        step, longest, shorter, length = self.automaton.step, self.automaton.longest, self.automaton.shorter, self.automaton.length
        known, state, end = self.known, 0, 0
        for byte in data:
            end += 1
            state = step[state << 8 | byte]
            token = longest[state]
            while token >= 0:
                start = end - length[token]
                if not start:
                    last[end] = token
                    break
                before = last[start]
                if before >= 0:
                    stable = known.get(before << 32 | token)
                    if stable is None:
                        stable = self.follows(before, token)
                    if stable:
                        last[end] = token
                        break
                token = shorter[token]
        ids, at = [], len(data)
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        return ids[::-1]

    def _chunk(self, chunk: str) -> str:
        if chunk.isascii() and (chunk[1:] if chunk[0] == " " else chunk).isalpha():
            return ",".join(map(str, self.piece(chunk)))
        return ",".join(str(i) for p in self.pieces(chunk) for i in self.piece(p))

    def encode_csv(self, text: str | None) -> str:
        """The ids of a text, joined by commas."""
        if not text:
            return ""
        known = self.memory.__getitem__
        parts = self.cut_added(text) if self.cut_added and any(t in text for t in self.added) else [text]
        return ",".join(
            s for k, part in enumerate(parts) if part for s in ([str(self.added[part])] if k % 2 else [",".join(map(known, self.chunks(part)))])
        )

    def encode(self, text: str | None) -> np.ndarray:
        csv = self.encode_csv(text)
        return np.fromstring(csv, np.int32, sep=",") if csv else np.zeros(0, np.int32)

    def decode_csv(self, csv: str) -> str:
        return b"".join(map(self.bytes_of.__getitem__, csv.split(","))).decode("utf-8", "replace") if csv else ""

    def decode(self, ids) -> str:
        return b"".join(map(self.tokens.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "replace") if ids is not None else ""


_CODEC: dict[str, Codec] = {}


def _codec(key: str, vocabulary) -> Codec:
    """One codec per process and vocabulary, until another operator's task comes."""
    take_over("bpe", _CODEC.clear)
    if key not in _CODEC:
        _CODEC.clear()
        _CODEC[key] = Codec(vocabulary.value)
    return _CODEC[key]


_READ: dict[str, dict] = {}


def _shipped(docs: DataFrame, path: str):
    if path not in _READ:
        _READ[path] = read_vocabulary(path)
    return docs.sparkSession.sparkContext.broadcast(_READ[path])


def _stretches(texts: pa.Array) -> Iterator[tuple[int, list]]:
    """(first row, texts) of stretches of about ``PIECE`` characters; a longer text is one of its own."""
    first, held, size = 0, [], 0
    for k in range(len(texts)):
        text = texts[k].as_py()
        held.append(text)
        size += len(text or "")
        if size >= PIECE:
            yield first, held
            first, held, size = k + 1, [], 0
    if held:
        yield first, held


def encode(docs: DataFrame, path: str, name: str = "ids", text: str = "text", decoded: str | None = None) -> DataFrame:
    """Adds the token ids of each text, and under ``decoded`` the text that they stand for."""
    held = _shipped(docs, path)
    kept = docs.drop(*[c for c in (name, decoded) if c])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("kept"), F.col(f"`{text}`").cast("string").alias("text"))
    # Texts go to Python once: within the rows, or beside them if they are not there as strings.
    within = kept.columns.index(text) if text in kept.columns and kept.schema[text].dataType == T.StringType() else None
    if within is not None:
        rows = rows.select("kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, held)
        for batch in batches:
            for first, texts in _stretches(batch.column(1) if within is None else batch.column(0).field(within)):
                lists = [codec.encode(t) for t in texts]
                offsets = np.concatenate(([0], np.cumsum([len(i) for i in lists]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(offsets, np.concatenate(lists).astype(np.int32))
                back = [pa.array([codec.decode(i) for i in lists], pa.string())] if decoded else []
                yield pa.record_batch([batch.column(0).slice(first, len(texts)), ids, *back], ["kept", "ids", "decoded"][: 2 + bool(decoded)])

    kinds = T.StructType([rows.schema["kept"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    if decoded:
        kinds.add("decoded", T.StringType())
    out = rows.mapInArrow(run, kinds)
    columns = [F.col("ids").alias(name)] + ([F.col("decoded").alias(decoded)] if decoded else [])
    return out.select(*[F.col(f"kept.`{c}`") for c in kept.columns], *columns)


def decode(rows: DataFrame, path: str, name: str = "decoded", ids: str = "ids") -> DataFrame:
    """Adds the text that each row's ids stand for."""
    held = _shipped(rows, path)

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(path, held)
        for batch in batches:
            yield pd.Series([codec.decode(i) for i in batch], dtype=object)

    return rows.withColumn(name, decoded(F.col(ids)))
