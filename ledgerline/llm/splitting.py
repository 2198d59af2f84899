"""Oversized items cut at natural boundaries.

The text is split by a hierarchy of separators: section (where the chunk's blocks change it), paragraph (the chunk's
own blocks, blank lines), sentence, word, character. A part is split by the next level only if it exceeds the limit. The parts are then packed greedily into
pieces, each beginning with the tail of the piece before it.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.normalize import collapse_space, dashed_accession, label
from ledgerline.session import spread

LIMIT, OVERLAP = 1500, 150
LEVELS = ("section", "block", "sentence", "word", "character")
_RUN = re.compile(r"\s+")
_SENTENCE_END = re.compile(r"(?<=[.!?]) ")


def squeeze(text: str) -> tuple[str, list[int]]:
    """Text with each whitespace run as one blank and none outside, and the places after a blank line."""
    out, at, breaks = [], 0, []
    pos = 0
    for m in _RUN.finditer(text):
        if m.start() > at:
            if out:
                pos += 1
                if gap.count("\n") > 1:
                    breaks.append(pos)
            out.append(text[at : m.start()])
            pos += m.start() - at
        gap, at = m.group() if out else "", m.end()
    if at < len(text):
        if out:
            pos += 1
            if gap.count("\n") > 1:
                breaks.append(pos)
        out.append(text[at:])
    return " ".join(out), breaks


def _atoms(text: str, starts: list[list[int]], limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Parts (start, end, level) within the limit; starts[l] are the sorted part starts of level l. A part ends before
    the blank that separates it from the next."""
    done: list[tuple[int, int, int]] = []
    todo = [(0, len(text), 0)]
    while todo:
        a, b, level = todo.pop()
        if b - a <= limit:
            done.append((a, b, level))
        elif level == len(starts):
            step = max(1, limit - overlap)
            done.extend((x, min(x + step, b), level + 1) for x in range(a, b, step))
        else:
            cuts = starts[level][bisect_right(starts[level], a) : bisect_left(starts[level], b)]
            edges = [a, *cuts, b + 1]
            todo.extend((x, y - 1, level + 1) for x, y in zip(reversed(edges[:-1]), reversed(edges[1:])))
    return done


def _places(text: str) -> tuple[list[int], list[int]]:
    return [m.end() for m in _SENTENCE_END.finditer(text)], [m.end() for m in re.finditer(" ", text)]


def boundary_of(text: str, limit: int = LIMIT, places: tuple[list[int], list[int]] | None = None) -> str:
    """The coarsest natural boundary at which pieces within the limit exist, by the splitter's own cuts: sentence, word
    or none."""
    deepest = max(level for _, _, level in _atoms(text, list(places or _places(text)), limit, 0))
    return ("sentence", "sentence", "word", "none")[deepest]


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, blocks: list[int] | None = None, sections: list[int] | None = None, places: tuple[list[int], list[int]] | None = None) -> list[tuple[int, int, str]]:
    """Pieces (start, end, level of the cut before it) of a squeezed text; blocks and sections are their starts in it.

    Every character but a separating blank lies in a piece, no piece exceeds limit, and a piece starts at most overlap
    characters before the end of the one before it, at a sentence start if there is one in reach, else a word start.
    """
    sentences, words = places or _places(text)
    atoms = _atoms(text, [sorted(set(sections or ())), sorted(set(blocks or ())), sentences, words], limit, overlap)
    out: list[tuple[int, int, str]] = []
    start, end, cut = 0, 0, 0
    for a, b, level in atoms:
        if b - start > limit:
            out.append((start, end, LEVELS[cut]))
            # The tail must leave room for the new part.
            low = max(end - overlap, b - limit, start + 1)
            tail = a
            for at in (sentences, words):
                k = bisect_left(at, low)
                if k < len(at) and at[k] < end:
                    tail = at[k]
                    break
            else:
                # Only inside a stretch without blanks is a tail cut between characters.
                if level == len(LEVELS) and low < end and a == end:
                    tail = low
            start, cut = tail, max(level - 1, 0)
        end = b
    out.append((start, end, LEVELS[cut]))
    return out


def block_starts(text: str, blocks: list[tuple[int, int, str | None]] | None) -> tuple[list[int], list[int]]:
    """(starts of blocks, starts of those that change the section) in the squeezed text they were joined to; stops at the
    first that does not fit. Blocks are known by length, CRC-32 and section; empty ones take no place."""
    at, out, sections, now = 0, [], [], None
    for n, crc, section in blocks or ():
        if not n:
            continue
        if zlib.crc32(text[at : at + n].encode("utf-8", "surrogatepass")) != crc:
            break
        if at:
            out.append(at)
            if section != now:
                sections.append(at)
        now = section
        at += n + 1
    return out, sections


_OUT = pa.schema([("chunk_key", pa.int64()), ("section", pa.string()), ("boundary", pa.string()), ("piece_no", pa.int32()), ("start_pos", pa.int32()), ("cut", pa.string()), ("piece", pa.string())])


def _split(limit: int, overlap: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, section, raw, blocks in zip(*(c.to_pylist() for c in batch.columns)):
                text, breaks = squeeze(raw)
                if len(text) <= limit:
                    continue
                starts, sections = block_starts(text, [(b["n"], b["crc"], b["section"]) for b in blocks or ()])
                places = _places(text)
                cuts = split_text(text, limit, overlap, breaks + starts, sections, places)
                bound = boundary_of(text, limit, places)
                rows += [(key, section, bound, i, a, cut, text[a:b]) for i, (a, b, cut) in enumerate(cuts)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _OUT.types)], schema=_OUT)

    return work


def split_oversized(chunks: DataFrame, blocks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of each prose chunk whose squeezed text is longer than limit.

    Gives (chunk_key, section, boundary, piece_no, start_pos, cut, piece). Null, empty and short texts and other kinds
    give nothing; each repeated row gives its own pieces; unknown, null or ill-fitting blocks leave sentence, word and
    character cuts. Only chunks over the limit take part in the join with their blocks, and of the blocks only length,
    checksum and section, not their texts.
    """
    big = spread(chunks.where((label("kind") == "prose") & (F.length("text") > limit)).select("chunk_key", "section", "text", dashed_accession("accession_number").alias("acc"), "source_orders"))
    wanted = big.select("acc", "source_orders").distinct().select("acc", "source_orders", F.posexplode("source_orders").alias("at", "block_order"))
    squeezed = collapse_space("text")
    block = F.struct(F.coalesce(F.length(squeezed), F.lit(0)).alias("n"), F.coalesce(F.crc32(squeezed.cast("binary")), F.lit(0)).alias("crc"), "section")
    known = blocks.select(dashed_accession("accession_number").alias("acc"), "block_order", "block_id", block.alias("block")).groupBy("acc", "block_order").agg(F.min_by("block", "block_id").alias("block"))
    found = (
        wanted.join(known, ["acc", "block_order"])
        .groupBy("acc", "source_orders").agg(F.array_sort(F.collect_list(F.struct("at", "block"))).alias("blocks"))
        .select("acc", "source_orders", F.col("blocks.block").alias("blocks"))
    )
    return big.join(found, ["acc", "source_orders"], "left").select("chunk_key", "section", "text", "blocks").mapInArrow(
        _split(limit, overlap), "chunk_key bigint, section string, boundary string, piece_no int, start_pos int, cut string, piece string"
    )
