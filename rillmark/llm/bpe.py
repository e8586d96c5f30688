"""Byte-level BPE by overlapping chunks.

A text is cut into chunks of `chunk` characters. Each is pre-tokenised on its own, from its start to
`overlap` characters beyond its end. The pre-token pattern looks ahead but never back, so once two
neighbours share a boundary in their overlap they agree from there on: the left chunk's pieces are
taken up to that boundary and the right one's behind it. They can meet nowhere but in the overlap,
so a chunk's task encodes all pieces by the merge ranks, those between the two overlaps as one run;
what is left to do for a text is to find where its chunks meet and to concatenate. Where two never
meet (a run longer than the overlap), the rest of the text is done from the last settled boundary.
Decoding concatenates the ids' bytes.

The chunks of long texts are dealt over the cluster; a text of one chunk needs no shuffle.
"""

from __future__ import annotations

import base64
import copy
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .common import each_text, partitions, stored, transposed

CHUNK = 32_768
OVERLAP = 1_024
LOOK = 4  # characters that must follow a match before its end is certain
CACHE = 200_000
VOCABULARY_BYTES = 64 << 20


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line.strip())}


class Codec:
    """Pre-tokenises, encodes single pieces and decodes ids; frequent pieces are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        # its own pattern takes a piece as it is, so that only the merges are left to do
        self.merges = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = {i: b for b, i in ranks.items()}
        self.cache: dict[str, tuple[str, bytes]] = {}

    def fresh(self) -> Codec:
        """The same without what is remembered: a task's pieces go with it, and do not stay in a worker that goes on to other stages."""
        own = copy.copy(self)
        own.cache = {}
        return own

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def piece(self, piece: str) -> tuple[str, bytes]:
        """Its ids in decimal, space-joined, and the bytes that they decode to."""
        got = self.cache.get(piece)
        if got is None:
            ids = self.merges.encode_ordinary(piece)
            got = (" ".join(map(str, ids)), self.decode(ids))
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[piece] = got
        return got

    def decode(self, ids) -> bytes:
        return b"".join([self.token_bytes[int(i)] for i in ids])


@lru_cache(maxsize=2)
def codec(content: bytes, pattern: str) -> Codec:
    return Codec(read_ranks(content), pattern)


def windows(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """Start and text of each chunk; an empty text has one."""
    starts = range(0, max(1, len(text)), chunk)
    return [(a, text[a : a + chunk + overlap]) for a in starts]


Piece = tuple[int, tuple[str, bytes]]  # where it ends in the text, and what it encodes to


@dataclass
class Chunk:
    """A chunk's pieces: those that end in the overlap with the chunk before, all others up to its end, those in its own overlap."""

    start: int
    window: str
    head: list[Piece]
    body: tuple[str, bytes]
    body_end: int  # 0: no piece
    tail: list[Piece]


def scan_chunk(own: Codec, start: int, window: str, last: bool, chunk: int, overlap: int) -> Chunk:
    """Pieces whose ends more text could move are left out, unless there is no more."""
    head, body, tail, body_end = [], [], [], 0
    first, end = start + overlap if start else 0, start + chunk
    for m in own.pattern.finditer(window):
        e = start + m.end()
        if not last and m.end() > len(window) - LOOK:
            break
        got = own.piece(m[0])
        if e >= end and not last:
            tail.append((e, got))
        elif e <= first:
            head.append((e, got))
        else:
            body.append(got)
            body_end = e
    return Chunk(start, window, head, joined(body), body_end, tail)


def joined(parts: list[tuple[str, bytes]]) -> tuple[str, bytes]:
    return " ".join([x for x, _ in parts if x]), b"".join([b for _, b in parts])


def _marks(c: Chunk) -> Iterator[int]:
    """Places where a chunk's own pieces are known to begin or end."""
    yield c.start
    yield from (e for e, _ in c.head)
    yield from (e for e, _ in c.tail)


def resumed(own: Codec, chunks: list[Chunk], settled: int, chunk: int, marks: dict[int, int]) -> tuple[list[tuple[str, bytes]], int, int]:
    """Pieces from the settled place on, up to the next place that a later chunk knows too; that place and the chunk, or the end of the text.

    Text is taken chunk by chunk, twice as many each time, so a run over many chunks is matched a fixed number of times.
    """
    i, taken = settled // chunk, 1
    parts = [c.window[:chunk] for c in chunks[:-1][i : i + 1]] or [chunks[-1].window]
    buffer, at, out = parts[0][settled - i * chunk :], settled, []
    while True:
        whole, pos = i + taken >= len(chunks), 0
        for m in own.pattern.finditer(buffer):
            if not whole and m.end() > len(buffer) - LOOK:
                break
            out.append(own.piece(m[0]))
            pos = m.end()
            if at + pos in marks:
                return out, at + pos, marks[at + pos]
        if whole:
            return out, at + len(buffer), len(chunks)
        more = chunks[i + taken : i + 2 * taken]
        buffer = buffer[pos:] + "".join([c.window if c is chunks[-1] else c.window[:chunk] for c in more])
        at, taken = at + pos, taken + len(more)


def stitched(own: Codec, chunks: list[Chunk], chunk: int) -> tuple[str, bytes]:
    """What the whole text encodes to, from its chunks in order of start.

    Where a chunk and the next do not meet, as within a run of letters that is longer than the overlap, the text is done anew from there
    to the next place that a later chunk knows, and its pieces go on from there.
    """
    out: list[tuple[str, bytes]] = []
    settled, k = 0, 0
    marks: dict[int, int] | None = None
    while True:
        c = chunks[k]
        mine = [p for p in c.head if p[0] > settled]
        out += [x for _, x in mine]  # the settled place is one of this chunk's ends, and none of its body
        if c.body_end > settled:
            out.append(c.body)
            settled = c.body_end
        elif mine:
            settled = mine[-1][0]
        if k + 1 == len(chunks):
            return joined(out)
        known = set(_marks(chunks[k + 1]))
        if settled not in known:
            mine = [p for p in c.tail if p[0] > settled]
            meet = next((i for i, (e, _) in enumerate(mine) if e in known), None)
            if meet is None:
                if marks is None:
                    marks = {e: j for j in range(len(chunks) - 1, 0, -1) for e in _marks(chunks[j])}
                parts, settled, k = resumed(own, chunks, settled, chunk, marks)
                out += parts
                if k == len(chunks):
                    return joined(out)
                continue
            out += [x for _, x in mine[: meet + 1]]
            settled = mine[meet][0]
        k += 1


def digests(encoded: tuple[str, bytes]) -> tuple[int, str, str]:
    ids, content = encoded
    return (ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(content).hexdigest())


def id_lists(encoded: tuple[str, bytes]) -> tuple[list[int]]:
    return ([int(i) for i in encoded[0].split()],)


FINISH: dict[str, tuple[Callable, str]] = {
    "digests": (digests, "n_tokens long, ids_sha256 string, decoded_sha256 string"),
    "ids": (id_lists, "ids array<int>"),
}


def vocabulary(path: str) -> bytes:
    """The rank file's content; it is broadcast, so its size is checked."""
    with open(path, "rb") as f:
        content = f.read(VOCABULARY_BYTES + 1)
    if len(content) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    return content


def encode(docs: DataFrame, path: str, pattern: str, output: str = "ids", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and the output's columns for each row of docs.

    output "ids": the ids as an array; "digests": their number, the SHA-256 of the ids in decimal,
    and that of the bytes that they decode to. A null text is an empty one: no ids. Repeated rows
    give repeated results; text is read whole, other columns are not read.
    """
    finish, columns = FINISH[output]
    width = len(columns.split(", "))
    content = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    slim = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def short():
        own = codec(content.value, pattern).fresh()
        return lambda texts: transposed([finish(joined([own.piece(p) for p in own.pieces(t)])) for t in texts], width)

    piece = pa.list_(pa.struct([("end", pa.int64()), ("ids", pa.string()), ("bytes", pa.binary())]))
    shape = pa.schema([("row", pa.int64()), ("start", pa.int32()), ("window", pa.string()), ("head", piece), ("ids", pa.string()), ("bytes", pa.binary()), ("body_end", pa.int64()), ("tail", piece)])

    def listed(pieces: list[Piece]) -> list[dict]:
        return [{"end": e, "ids": x, "bytes": b} for e, (x, b) in pieces]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(content.value, pattern).fresh()
        for batch in batches:
            for row in batch.to_pylist():
                c = scan_chunk(own, row["start"], row["window"], row["last"], chunk, overlap)
                yield pa.RecordBatch.from_pylist([{"row": row["row"], "start": c.start, "window": c.window, "head": listed(c.head), "ids": c.body[0], "bytes": c.body[1], "body_end": c.body_end, "tail": listed(c.tail)}], shape)

    result = pa.schema([("row", pa.int64()), *to_arrow_type(StructType.fromDDL(columns))])

    def join_up(part: pa.Table) -> pa.Table:
        own = codec(content.value, pattern).fresh()
        chunks = [
            Chunk(r["start"], r["window"], [(p["end"], (p["ids"], p["bytes"])) for p in r["head"]], (r["ids"], r["bytes"]), r["body_end"], [(p["end"], (p["ids"], p["bytes"])) for p in r["tail"]])
            for r in part.sort_by("start").to_pylist()
        ]
        row = finish(stitched(own, chunks, chunk))
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip((part["row"][0].as_py(), *row), result)], schema=result)

    is_long = F.length("text") > chunk
    long = stored(slim.filter(is_long).withColumn("row", F.monotonically_increasing_id()), "bpe-long")  # ids may repeat
    dealt = long.select("row", F.length("text").alias("n"), "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(chunk))).alias("start")).select(
        "row", "start", F.substring("text", F.col("start") + 1, F.lit(chunk + overlap)).alias("window"), (F.col("start") + chunk >= F.col("n")).alias("last")
    )
    dealt = dealt.repartition(partitions(slim.sparkSession), "row", "start")
    scanned = dealt.mapInArrow(scan, "row long, start int, window string, head array<struct<end: long, ids: string, bytes: binary>>, ids string, bytes binary, body_end long, tail array<struct<end: long, ids: string, bytes: binary>>")
    encoded = scanned.groupBy("row").applyInArrow(join_up, f"row long, {columns}")
    names = [c.split(" ")[0] for c in columns.split(", ")]
    by_row = long.select("row", "doc_id").join(encoded, "row").select("doc_id", *names)
    done = slim.filter(~is_long).select("doc_id", each_text(short, columns)("text").alias("_r")).select("doc_id", "_r.*")
    return done.unionByName(by_row)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and bytes (binary: the ids' bytes, concatenated) from doc_id and ids. Null ids give null."""
    content = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))

    def make():
        own = codec(content.value, r"\S+")
        return lambda lists: ([None if x is None else own.decode(x) for x in lists],)

    return encoded.select("doc_id", each_text(make, "bytes binary")("ids").alias("_r")).select("doc_id", "_r.bytes")
