"""Text decoded with the wrong character encoding: found and restored by transformations learned from twins.

Pieces of text that are equal once their non-ASCII characters are left out are twins. Where a rare surface has a more
frequent twin, the characters between the same ASCII neighbours are aligned, and each aligned pair is held against
the ways bytes can be misread. Transformations that explain pairs no other explains are accepted, and their
mappings, so far as the corpus' own character counts support them, are applied to all records.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import materialize, spread

#: Encodings UTF-8 bytes may have been read with.
READERS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "cp852", "cp866", "iso8859-2", "iso8859-15", "cp1253", "cp1254", "cp1257", "koi8_r", "mac_latin2")
#: Single-byte encodings that may have been read as one another.
SINGLE = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859-2", "cp1253")
#: Distinct aligned characters a single-byte transformation must explain, as one alone may be chance.
SINGLE_SUPPORT = 3
LOST = "�"
MARK = "\ufeff"
_CJK = "⺀-鿿가-힯豈-﫿＀-￯"
_RUN = re.compile("[^\x00-\x7f]+")
_WESTERN_RUN = re.compile(f"[^\x00-\x7f{_CJK}]+")
_EDGE = re.compile(f"[ \t\n\r\f\v{_CJK}]")
_WORD = re.compile(r"\S+")
_DIGITS = str.maketrans("123456789", "000000000")


@lru_cache(None)
def char_bytes(codec: str) -> dict[str, int]:
    """Character to byte; bytes the encoding leaves undefined stand for the control characters of that number."""
    out = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


@lru_cache(None)
def misread_pattern(codec: str) -> re.Pattern:
    """What well-formed multi-byte UTF-8 looks like when read with codec."""
    of = {b: c for c, b in char_bytes(codec).items()}
    some = lambda a, b: "[" + "".join(re.escape(of[x]) for x in range(a, b) if x in of) + "]"
    tail = some(0x80, 0xC0)
    return re.compile(f"{some(0xC2, 0xE0)}{tail}|{some(0xE0, 0xF0)}{tail}{{2}}|{some(0xF0, 0xF5)}{tail}{{3}}")


def reread(seq: str, codec: str) -> str | None:
    """The character a misread sequence stands for, if it is one."""
    table = char_bytes(codec)
    try:
        return bytes(table[c] for c in seq).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None


def unread(run: str, codec: str) -> str:
    return misread_pattern(codec).sub(lambda m: reread(m.group(), codec) or m.group(), run)


@lru_cache(None)
def swap_table(written: str, read: str) -> dict[str, str]:
    """Garbled character to original, for bytes written in one single-byte encoding and read in another; some stay."""
    back = {b: c for c, b in char_bytes(written).items()}
    return {c: back[b] for c, b in char_bytes(read).items() if b > 127 and b in back}


def pieces(text: str) -> list[tuple[int, int]]:
    """Spans of the words (between blanks or CJK) that hold other non-ASCII characters."""
    out = []
    for m in _WESTERN_RUN.finditer(text):
        if out and m.start() < out[-1][1]:
            continue
        a, b = m.start(), m.end()
        while a and not _EDGE.match(text[a - 1]):
            a -= 1
        end = _EDGE.search(text, b)
        out.append((a, end.start() if end else len(text)))
    return out


def _neighbours(text: str, a: int, b: int) -> tuple[str, str]:
    """The words before and after a piece, whole, however long they are."""
    end = a
    while end and text[end - 1].isspace():
        end -= 1
    start = end
    while start and not text[start - 1].isspace():
        start -= 1
    after = _WORD.search(text, b)
    return text[start:end], after.group() if after else ""


def twin_key(text: str, a: int, b: int) -> tuple[str, str]:
    """(what a piece has in common with its twins, its surface), digits alike. Of a piece with next to no ASCII
    characters its neighbours are part of the key."""
    surface = text[a:b].translate(_DIGITS)
    key = _RUN.sub("", surface)
    if sum(c.isalnum() for c in key) < 3:
        left, right = (_RUN.sub("", x).translate(_DIGITS) for x in _neighbours(text, a, b))
        key = f"{left} {key} {right}"
    return key, surface


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted per batch: pieces (kind 0: key, surface), characters (1), runs (2)."""
    for batch in batches:
        found: Counter = Counter()
        chars: Counter = Counter()
        for text in batch.column(0).to_pylist():
            if not text or text.isascii():
                continue
            for run in _RUN.findall(text):
                chars.update(run)
            found.update((2, "", r) for r in _WESTERN_RUN.findall(text) if len(r) > 1)
            found.update((0, *twin_key(text, a, b)) for a, b in pieces(text))
        found.update({(1, "", c): n for c, n in chars.items()})
        if found:
            kind, key, surface = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key), pa.array(surface), pa.array(list(found.values()), pa.int64())], names=["kind", "key", "surface", "n"])


def align(garbled: str, clean: str) -> list[tuple[str, str]] | None:
    """Differing non-ASCII runs at the same places of the common ASCII text; None if the places differ."""
    split = lambda s: re.split("([^\x00-\x7f]+)", s)
    g, c = split(garbled), split(clean)
    if g[::2] != c[::2]:
        return None
    return [(x, y) for x, y in zip(g[1::2], c[1::2]) if x != y]


def explain(garbled: str, clean: str) -> tuple[list[str], list[str]]:
    """(reading codecs under which the run is misread UTF-8 of the other, single-byte transformations that map it)."""
    multi = []
    for codec in READERS:
        r, s = garbled, unread(garbled, codec)
        while s != r != clean:  # each round shortens the run
            r, s = s, unread(s, codec)
        if r == clean:
            multi.append(codec)
    single = []
    if len(garbled) == len(clean):
        for written in SINGLE:
            for read in SINGLE:
                if written != read and all(swap_table(written, read).get(x) == y for x, y in zip(garbled, clean)):
                    single.append(f"{written}>{read}")
    return multi, single


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: set[tuple] = set()
        for g, c in zip(*(x.to_pylist() for x in batch.columns)):
            for x, y in align(g, c) or ():
                multi, single = explain(x, y)
                if multi:
                    seen.add(("multi", " ".join(multi), x + "\t" + y))
                if single:
                    seen.update(("single", " ".join(single), a + "\t" + b) for a, b in zip(x, y))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*seen)], names=["kind", "ways", "pair"])


def _sequences(codecs: list[str]):
    """Runs to the misread sequences in them and the characters they stand for, over all rounds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: Counter = Counter()
            for run, n in zip(*(x.to_pylist() for x in batch.columns)):
                for codec in codecs:
                    for seq in misread_pattern(codec).findall(run):
                        if c := reread(seq, codec):
                            out[seq, c] += n
            if out:
                seq, c = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(seq), pa.array(c), pa.array(list(out.values()), pa.int64())], names=["seq", "original", "n"])

    return work


def _swapped(ways: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [(w, swap_table(*w.split(">"))) for w in ways]
        for batch in batches:
            rows = []
            for key, surface, n in zip(*(x.to_pylist() for x in batch.columns)):
                for w, t in tables:
                    if all(c.isascii() or c in t for c in surface) and (original := "".join(t.get(c, c) for c in surface)) != surface:
                        rows.append((key, surface, n, w, original))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()))], names=["key", "surface", "n", "way", "original"])

    return work


class Learned:
    """What a corpus taught: mapping (misread sequence to character), swaps (accepted single-byte transformations) and
    the DataFrame of garbled surfaces (key, surface, way) they account for."""

    def __init__(self, documents: DataFrame):
        spark = documents.sparkSession
        counts = spread(documents.select("text")).mapInArrow(_survey, "kind int, key string, surface string, n bigint").groupBy("kind", "key", "surface").agg(F.sum("n").alias("n"))
        counts = materialize(counts, "garble-counts")
        tokens = counts.where("kind = 0").select("key", "surface", "n")
        best = tokens.groupBy("key").agg(F.max(F.struct("n", "surface")).alias("best"), F.count(F.lit(1)).alias("forms")).where("forms > 1")
        twins = tokens.join(best.hint("merge"), "key").where("n < best.n").select(F.col("surface").alias("garbled"), F.col("best.surface").alias("clean"))
        evidence = twins.mapInArrow(_evidence, "kind string, ways string, pair string").groupBy("kind", "ways").agg(F.countDistinct("pair").alias("pairs"))
        rows = evidence.collect()  # as many rows as there are transformations and sets of them
        swaps = [f"{a}>{b}" for a in SINGLE for b in SINGLE]
        self.codecs, self.swaps = (self._cover({tuple(r.ways.split(" ")): r.pairs for r in rows if r.kind == kind}, least, order) for kind, least, order in (("multi", 1, list(READERS)), ("single", SINGLE_SUPPORT, swaps)))
        chars = counts.where("kind = 1").select(F.col("surface").alias("original"), F.col("n").alias("n_original"))
        if self.codecs:
            seqs = counts.where("kind = 2").select("surface", "n").mapInArrow(_sequences(self.codecs), "seq string, original string, n bigint").groupBy("seq", "original").agg(F.sum("n").alias("n"))
            # A misread byte order mark stands for no character at all.
            known = seqs.join(chars.hint("merge"), "original", "left").where((F.col("n_original") > F.col("n")) | (F.col("original") == MARK)).groupBy("seq").agg(F.max_by("original", F.struct("n_original", "original")).alias("original"))
            # Bounded by the alphabet: a sequence stands for one character of the corpus.
            self.mapping = {r.seq: r.original.replace(MARK, "") for r in known.collect()}
        else:
            self.mapping = {}
        if self.swaps:
            tried = tokens.mapInArrow(_swapped(self.swaps), "key string, surface string, n bigint, way string, original string")
            clean = tokens.select("key", F.col("surface").alias("original"), F.col("n").alias("n_original"))
            self.surfaces = tried.join(clean.hint("merge"), ["key", "original"]).where("n_original > n").groupBy("key", "surface").agg(F.max_by("way", F.struct("n_original", "way")).alias("way"))
        else:
            self.surfaces = spark.createDataFrame([], "key string, surface string, way string")

    @staticmethod
    def _cover(explained: dict[tuple[str, ...], int], least: int, order: list[str]) -> list[str]:
        """Transformations by pairs explained (on a tie the first in order), until none explains at least so many new ones."""
        out: list[str] = []
        left = dict(explained)
        while left:
            gain: Counter = Counter()
            for ways, n in left.items():
                gain.update({w: n for w in ways})
            best = min(gain, key=lambda w: (-gain[w], order.index(w)))
            if gain[best] < least:
                break
            out.append(best)
            left = {w: n for w, n in left.items() if best not in w}
        return out


def _any_of(seqs: list[str]) -> re.Pattern:
    return re.compile("|".join(map(re.escape, sorted(seqs, key=lambda s: (-len(s), s)))))


def _apply(mapping: dict[str, str], swaps: list[str], every: bool):
    """Of each document: that a learned sequence or a lost character occurs in it, and those of its pieces that an
    accepted single-byte transformation may apply to (of documents already found only with every)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _any_of([*mapping, LOST])
        tables = [swap_table(*w.split(">")) for w in swaps]
        movable = lambda x: any(all(c.isascii() or c in t for c in x) for t in tables)
        for batch in batches:
            rows = []
            for doc, text in zip(*(x.to_pylist() for x in batch.columns)):
                if not text or text.isascii():
                    continue
                if sure := bool(known.search(text)):
                    rows.append((doc, True, None, None))
                if tables and (every or not sure):
                    rows += [(doc, False, *t) for t in {twin_key(text, a, b) for a, b in pieces(text)} if movable(t[1])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.bool_(), pa.string(), pa.string()))], names=["doc_id", "sure", "key", "surface"])

    return work


_APPLIED = "doc_id bigint, sure boolean, key string, surface string"


def _seen(documents: DataFrame, learned: Learned, every: bool) -> DataFrame:
    """(doc_id, sure, key, surface, way) of what _apply finds, in one pass; way where the piece is a learned surface.
    Both sides grow with the corpus: the join is never a broadcast one."""
    seen = spread(documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), "text")).mapInArrow(_apply(learned.mapping, learned.swaps, every), _APPLIED)
    if not learned.swaps:
        return seen.withColumn("way", F.lit(None).cast("string"))
    return seen.join(learned.surfaces.hint("merge"), ["key", "surface"], "left").where("sure or way is not null")


def garbled(documents: DataFrame, learned: Learned | None = None) -> DataFrame:
    """(doc_id) of each document of documents (doc_id, text) whose text shows misread characters, each once.

    Null, empty and plain ASCII texts show none. A document is found by a learned sequence (also where only a part is
    garbled, or repeatedly; rows without an id are left out), by a replacement character, whose original is lost, or by a surface a learned
    single-byte transformation maps to a more frequent twin. Without twins nothing is learned; replacement characters
    are found all the same.
    """
    return _seen(documents, learned or Learned(documents), False).select("doc_id").distinct()


def restore_text(text: str, mapping: dict[str, str], ways: dict[tuple[str, str], str]) -> str:
    """Swapped pieces first, then learned sequences until nothing changes; lost characters stay."""
    out, at = [], 0
    for a, b in pieces(text):
        way = ways.get(twin_key(text, a, b))
        if way:
            t = swap_table(*way.split(">"))
            out += [text[at:a], "".join(t.get(c, c) for c in text[a:b])]
            at = b
    text = "".join(out) + text[at:]
    if mapping:
        known = _any_of(list(mapping))
        new = known.sub(lambda m: mapping[m.group()], text)
        while new != text:  # a sequence is longer than what it stands for, so this ends
            text, new = new, known.sub(lambda m: mapping[m.group()], new)
    return text


def _restore(mapping: dict[str, str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, keys, surfaces, ways in zip(*(x.to_pylist() for x in batch.columns)):
                new = restore_text(text or "", mapping, dict(zip(zip(keys or (), surfaces or ()), ways or ())))
                rows.append((doc, new, LOST not in new))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.bool_()))], names=["doc_id", "restored", "whole"])

    return work


def restored(documents: DataFrame) -> DataFrame:
    """(doc_id, restored, whole) of each found document: its text with all learned mappings undone; whole is false
    where lost characters remain."""
    learned = Learned(documents)
    docs = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), "text")
    marks = _seen(documents, learned, True).groupBy("doc_id").agg(F.collect_list(F.when(F.col("way").isNotNull(), F.struct("key", "surface", "way"))).alias("m"))
    return docs.join(marks.hint("merge"), "doc_id").select("doc_id", "text", "m.key", "m.surface", "m.way").mapInArrow(_restore(learned.mapping), "doc_id bigint, restored string, whole boolean")
