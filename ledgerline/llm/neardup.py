"""Near-duplicate records with small edits, by tiled comparison of bit signatures within blocks.

Texts become sets of word shingles; equal sets are one class and take part once. Each class has a bit signature: bit
b is the parity of its shingles hashed to b. The exclusive-or of two signatures has at most as many bits as the sets
differ in shingles, so for similarity t it has at most r = (1 - t) / (1 + t) * (|A| + |B|) bits, and population
counts further apart than r rule a pair out: filters that cannot lose a pair.

Comparing all tiles with all others takes time by the square of the collection, so classes are compared within the
buckets of the shingles of their prefixes. Shingles are put in one order for all sets, roughly rarest first. Two sets
that have c shingles in common share one of the first |A| - c + 1 of A and of the first |B| - c + 1 of B; similarity t
takes c >= t * |A|, so the first |A| - ceil(t * |A|) + 1 shingles of every set are enough, whatever the order is. With
each goes the largest partner it can still lead to. A bucket is cut into tiles of sets of like size and population
count, and tile pairs whose population counts differ beyond the radius are skipped; a shingle too frequent for a bucket
of its own is taken together with the next common one. Nothing is lost: what the signatures let pass is decided on the
shingle sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.words import Words, column_words, gram_hashes, mix
from ledgerline.session import drop_path, partitions_for, shared_path, spread

SHINGLE, SIMILARITY = 3, Fraction(3, 5)
#: Bits of a signature: the power of two from LEAST_BITS on that has at least BITS_PER_SHINGLE for each of the set's.
LEAST_BITS, BITS_PER_SHINGLE = 128, 1.6
#: Members of a tile. Buckets up to LARGE are compared by one task; the tile pairs of a larger one are dealt out in
#: squares of side SIDE.
TILE, LARGE, SIDE = 8, 1 << 15, 1 << 13
#: The order of shingles remembers so many.
ORDERED = 1 << 20
_FLUSH_ENTRIES = 4_000_000
_CHUNK_PAIRS = 2_000_000


def shingle_sets(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each set, its first index, sorted 32-bit shingle hashes) of the texts of k or more words."""
    grams = gram_hashes(w.hash, k)
    inside = w.text[: len(grams)] == w.text[k - 1 :] if len(grams) else np.empty(0, bool)
    tagged = np.sort((w.text[: len(grams)][inside].astype(np.uint64) << np.uint64(32)) | (grams[inside] >> np.uint64(32)))
    if len(tagged):
        tagged = tagged[np.r_[True, tagged[1:] != tagged[:-1]]]
    text = (tagged >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.empty(0, np.int64)
    return text[first], first, (tagged & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def signature_bits(n: np.ndarray) -> np.ndarray:
    """Width of the signature of a set of n shingles: narrower ones could not tell sets of that size apart."""
    return np.maximum(LEAST_BITS, 2 ** np.ceil(np.log2(np.maximum(n, 1) * BITS_PER_SHINGLE)).astype(np.int64))


def signatures(size: np.ndarray, tokens: np.ndarray, bits: int) -> np.ndarray:
    """One row of bits // 64 words per set. The halves of a row, one xor the other, are the row of half the bits."""
    n = len(size)
    owner = np.repeat(np.arange(n), size)
    h = tokens * np.uint32(0x85EBCA6B)
    bit = ((h ^ (h >> np.uint32(15))) & np.uint32(bits - 1)).astype(np.int64)
    parity = (np.bincount(owner * bits + bit, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(n, bits), axis=1).view(np.uint64)


def fold(sig: np.ndarray, words: int) -> np.ndarray:
    while sig.shape[1] > words:
        half = sig.shape[1] // 2
        sig = sig[:, :half] ^ sig[:, half:]
    return sig


class Signatures:
    """Signatures of sets, each of the width its size takes, at every width: rows of one width and where a set's is."""

    def __init__(self, n: np.ndarray, by_bits: dict[int, tuple[np.ndarray, np.ndarray]]):
        """by_bits: width to (sets, their rows)."""
        self.levels, self.bits = [], signature_bits(n)
        for bits in sorted(by_bits):
            rows, at = [], np.full(len(n), -1)
            for wide in sorted(by_bits):
                if wide >= bits:
                    sets, sig = by_bits[wide]
                    at[sets] = np.arange(len(sets)) + sum(map(len, rows))
                    rows.append(fold(sig, bits // 64))
            self.levels.append((bits, np.concatenate(rows), at))

    def population(self) -> np.ndarray:
        """Bits set in each set's signature at the least width."""
        _, rows, at = self.levels[0]
        return np.bitwise_count(rows).sum(1, dtype=np.int64)[at]

    def near(self, x: np.ndarray, y: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose signatures differ in no more than room bits, at every width both have."""
        for i, (bits, rows, at) in enumerate(self.levels):
            both = np.minimum(self.bits[x], self.bits[y]) >= bits if i else np.ones(len(x), bool)
            good = ~both
            good[both] = np.bitwise_count(rows[at[x[both]]] ^ rows[at[y[both]]]).sum(1, dtype=np.int64) <= room[both]
            x, y, room = x[good], y[good], room[good]
        return x, y


def class_hashes(first: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, independent of order."""
    t = tokens.astype(np.uint64)
    a, b = mix(t + np.uint64(0x1B873593)), mix(t ^ np.uint64(0xCC9E2D51A5A5A5A5))
    return mix(np.add.reduceat(a, first)).view(np.int64), mix(np.add.reduceat(b, first)).view(np.int64)


def most_partner(r: np.ndarray, n: np.ndarray, t: Fraction) -> np.ndarray:
    """Largest set that a set of n can be similar to if they have no more than r shingles in common."""
    return r * (t.denominator + t.numerator) // t.numerator - n


def prefixes(size: np.ndarray, tokens: np.ndarray, order: tuple[np.ndarray, np.ndarray], t: Fraction, hot: int = 1 << 62) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, key, largest partner) of the prefixes of sets. order: sorted shingles and how frequent they are; others
    count as rarest, and ties go by the shingle.

    A shingle of frequency hot or more is no key by itself. Two sets whose first common shingle it is have a second one,
    which comes no later than one place beyond the prefix, and the two together are the key. (Only sets so small that
    one common shingle may do keep the one.)
    """
    at = np.minimum(np.searchsorted(order[0], tokens), max(0, len(order[0]) - 1))
    often = np.where(order[0][at] == tokens, np.minimum(order[1][at], 0xFFFF), 0).astype(np.uint64) if len(order[0]) else np.zeros(len(tokens), np.uint64)
    sets, keys, most = [], [], []
    ends = np.r_[0, np.cumsum(size)]
    for c in range(0, len(size), 1 << 16):  # so that a set's number has room beside its shingles
        n = size[c : c + (1 << 16)]
        span = slice(ends[c], ends[min(c + (1 << 16), len(size))])
        owner = np.repeat(np.arange(len(n)), n)
        ranked = np.sort((owner.astype(np.uint64) << np.uint64(48)) | (often[span] << np.uint64(32)) | tokens[span])
        place = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
        rest = n[owner] - place
        keep = np.flatnonzero(rest * t.denominator >= n[owner] * t.numerator)
        is_hot = ((ranked[keep] >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64) >= hot
        first = keep[is_hot]
        keep = keep[~is_hot | (n[owner[keep]] * t.numerator <= t.denominator)]
        sets.append(owner[keep] + c)
        keys.append(ranked[keep].astype(np.uint32))
        most.append(most_partner(rest[keep], n[owner[keep]], t))
        if len(first):
            m = n[owner[first]]
            last = np.minimum(m - 1, m + 1 - -(-m * t.numerator // t.denominator))
            times = np.maximum(last - place[first], 0)
            one = np.repeat(first, times)
            two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(times) - times, times)
            sets.append(owner[one] + c)
            keys.append((mix((ranked[one] << np.uint64(32)) ^ (ranked[two] & np.uint64(0xFFFFFFFF))) >> np.uint64(32)).astype(np.uint32))
            most.append(most_partner(1 + rest[two], n[owner[two]], t))
    sets, keys, most = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (sets, keys, most))
    sort = np.argsort(sets, kind="stable")
    return sets[sort], keys[sort].astype(np.uint32), most[sort]


def pack_most(most: np.ndarray, n: np.ndarray, t: Fraction) -> np.ndarray:
    """Largest partners in a byte, as shares of the way from t * n to n / t, rounded up."""
    return np.clip(np.ceil((most - n * float(t)) / (n * (1 / float(t) - float(t))) * 255), 0, 255).astype(np.uint8)


def unpack_most(b: np.ndarray, n: np.ndarray, t: Fraction) -> np.ndarray:
    return np.floor(n * (float(t) + b * ((1 / float(t) - float(t)) / 255)) + 1e-6).astype(np.int64)


def _ragged(count: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the item, place in it) of items with so many places each, in portions of about most places."""
    ends = np.cumsum(count)
    a = 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        w = count[a:b]
        i = np.repeat(np.arange(a, b), w)
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w)
        a = b


def tile_pairs(key: np.ndarray, n: np.ndarray, population: np.ndarray, most: np.ndarray, t: Fraction, side: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries of equal key, compared tile by tile; entries are sorted by key, then n.

    Each bucket is cut into tiles of side entries. Tile pairs are skipped whose population counts are further apart
    than the radius of their largest sets, or whose sizes rule all their pairs out. Of the others come all pairs of
    entries whose sizes may be similar and that both can lead to.
    """
    if not len(key):
        return
    bucket = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    held = np.diff(np.r_[bucket, len(key)])
    tiles = -(-held // side)
    first = np.repeat(np.cumsum(tiles) - tiles, tiles)  # of its bucket, for each tile
    start = np.repeat(bucket, tiles) + side * (np.arange(len(first)) - first)
    wide = np.minimum(side, np.repeat(bucket + held, tiles) - start)
    n_low, n_high = n[start], n[start + wide - 1]
    p_low, p_high, leads = np.minimum.reduceat(population, start), np.maximum.reduceat(population, start), np.maximum.reduceat(most, start)
    for v, u in _ragged(np.arange(len(first)) - first + 1, 4 * _CHUNK_PAIRS // side**2):
        u = u + first[v]
        room = radius(n_high[u], n_high[v], t)
        ok = (p_low[u] <= p_high[v] + room) & (p_low[v] <= p_high[u] + room)
        ok &= (n_high[u] * t.denominator >= n_low[v] * t.numerator) & (leads[u] >= n_low[v])
        v, u = v[ok], u[ok]
        for k, place in _ragged(wide[u] * wide[v], _CHUNK_PAIRS):
            i, j = start[v[k]] + place // wide[u[k]], start[u[k]] + place % wide[u[k]]
            good = (j < i) & (n[i] <= most[j]) & (n[j] <= most[i]) & (n[j] * t.denominator >= n[i] * t.numerator)
            yield i[good], j[good]


def radius(n_a: np.ndarray, n_b: np.ndarray, t: Fraction) -> np.ndarray:
    """Most bits the signatures of sets of these sizes may differ in at similarity t or more."""
    return (n_a + n_b) * (t.denominator - t.numerator) // (t.denominator + t.numerator)


def similar(common: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, t: Fraction) -> np.ndarray:
    return common * (t.denominator + t.numerator) >= (n_a + n_b) * t.numerator


def compare_tiles(sig_a: np.ndarray, n_a: np.ndarray, sig_b: np.ndarray, n_b: np.ndarray, t: Fraction, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (a, b) of two tiles that the signatures do not rule out; of one tile with itself, a before b."""
    pop_a, pop_b = np.bitwise_count(sig_a).sum(1, dtype=np.int64), np.bitwise_count(sig_b).sum(1, dtype=np.int64)
    most = int(radius(n_a.max(), n_b.max(), t))
    if pop_a.min() > pop_b.max() + most or pop_b.min() > pop_a.max() + most:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    apart = np.zeros((len(n_a), len(n_b)), np.int64)
    for i in range(sig_a.shape[1]):
        apart += np.bitwise_count(sig_a[:, i, None] ^ sig_b[None, :, i])
    good = apart <= radius(n_a[:, None], n_b[None, :], t)
    return np.nonzero(np.triu(good, 1) if same else good)


#: body is the tokens, of which signatures are made where they are needed: every use of the classes' exchange needs the
#: same columns and all share it. ref is what the parts know a class by.
_CLASS = "ref bigint, h1 bigint, h2 bigint, body binary"
REF_BITS = 40


def refs_of(h1: np.ndarray) -> np.ndarray:
    return (h1.view(np.uint64) >> np.uint64(64 - REF_BITS)).astype(np.int64)


def _fano(size: np.ndarray, values: np.ndarray, low: int, spread: int) -> list[bytes]:
    """Sorted values of each set (Elias and Fano): low bytes plainly, what is above them, less than spread, as gaps in a
    bit row of spread and a bit for each. Nothing for an empty set."""
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size)), size)
    width = np.where(size > 0, spread + -(-size // 8) * 8, 0)
    at = np.cumsum(width) - width
    row = np.zeros(int(width.sum()), np.uint8)
    row[at[owner] + (values >> np.uint32(8 * low)).astype(np.int64) + np.arange(len(values)) - first[owner]] = 1
    high, a = np.packbits(row), at // 8
    plain = values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :low]
    return [high[i : i + w // 8].tobytes() + plain[f : f + n].tobytes() for i, w, f, n in zip(a.tolist(), width.tolist(), first.tolist(), size.tolist())]


def _unfano(parts: list[bytes], low: int, spread: int) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(p) for p in parts], np.int64)
    size = np.where(length > 0, (length - spread // 8) * 8 // (8 * low + 1), 0)
    wide = np.where(length > 0, spread // 8 + -(-size // 8), 0)
    row = np.flatnonzero(np.unpackbits(np.frombuffer(b"".join(p[:w] for p, w in zip(parts, wide.tolist())), np.uint8)))
    owner, first = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
    high = row - ((np.cumsum(wide) - wide) * 8)[owner] - (np.arange(len(row)) - first[owner])
    plain = np.frombuffer(b"".join(p[w:] for p, w in zip(parts, wide.tolist())), np.uint8).reshape(-1, low).astype(np.uint32)
    values = high.astype(np.uint32) << np.uint32(8 * low)
    for i in range(low):
        values |= plain[:, i] << np.uint32(8 * i)
    return size, values


def encode_tokens(size: np.ndarray, tokens: np.ndarray, known: np.ndarray) -> list[bytes]:
    """Each set's sorted tokens in short form: those of the sorted list known (2^20 at most) by their place in it, in
    two bytes and a bit each, the others in three."""
    at = np.minimum(np.searchsorted(known, tokens), max(0, len(known) - 1))
    is_known = known[at] == tokens if len(known) else np.zeros(len(tokens), bool)
    owner = np.repeat(np.arange(len(size)), size)
    n = np.bincount(owner[is_known], minlength=len(size))
    a, b = _fano(n, at[is_known].astype(np.uint32), 2, 16), _fano(size - n, tokens[~is_known], 3, 256)
    return [len(x).to_bytes(4, "little") + x + y for x, y in zip(a, b)]


def decode_tokens(col: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and all tokens of a column of encoded sets; a set's tokens are together, in no order."""
    rows = col.to_pylist()
    cut = [4 + int.from_bytes(r[:4], "little") for r in rows]
    n_a, a = _unfano([r[4:c] for r, c in zip(rows, cut)], 2, 16)
    n_b, b = _unfano([r[c:] for r, c in zip(rows, cut)], 3, 256)
    owner = np.concatenate([np.repeat(np.arange(len(rows)), n_a), np.repeat(np.arange(len(rows)), n_b)])
    return n_a + n_b, np.concatenate([known[a] if len(a) else a, b])[np.argsort(owner, kind="stable")]


def _classes(k: int, known: np.ndarray):
    """Classes of a task, each once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for w in column_words(batch.column(1)):
                text, first, tokens = shingle_sets(w, k)
                if not len(text):
                    continue
                h1, h2 = class_hashes(first, tokens)
                keep = [i for i, key in enumerate(zip(h1.tolist(), h2.tolist())) if not (key in seen or seen.add(key))]
                if not keep:
                    continue
                coded = encode_tokens(np.diff(np.r_[first, len(tokens)]), tokens, known)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(refs_of(h1[keep])), pa.array(h1[keep]), pa.array(h2[keep]),
                        pa.array([coded[i] for i in keep], pa.binary()),
                    ],
                    names=["ref", "h1", "h2", "body"],
                )

    return work


def _members(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for w in column_words(batch.column(1)):
                text, first, tokens = shingle_sets(w, k)
                if len(text):
                    h1, h2 = class_hashes(first, tokens)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[w.first + text]), pa.array(h1), pa.array(h2)], names=["id", "h1", "h2"])

    return work


def _planes(x: np.ndarray, width: int = 4) -> bytes:
    """Numbers byte by byte, the lowest bytes of all first: the high ones are zeros, which the exchange's codec drops."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplanes(b: bytes, width: int = 4) -> np.ndarray:
    rows = np.frombuffer(b, np.uint8).reshape(width, -1)
    return sum(rows[i].astype(np.int64) << (8 * i) for i in range(width))


def _merged(tokens: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens, sorted, with the sums of their counts."""
    token = np.concatenate(tokens)
    sort = np.argsort(token, kind="stable")
    token = token[sort]
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    return token[first], np.add.reduceat(np.concatenate(counts)[sort], first)


def _counted(k: int, parts: int):
    """How many of a task's texts have each shingle, packed by ranges of the shingles: four bytes each and their counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def give() -> pa.RecordBatch:
            edge = np.searchsorted(tokens[0], np.array([(p << 32) // parts for p in range(1, parts)], np.uint64))
            rows = [(p, t.tobytes(), _planes(n)) for p, (t, n) in enumerate(zip(np.split(tokens[0], edge), np.split(counts[0], edge))) if len(t)]
            tokens.clear(), counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["part", "tokens", "counts"])

        merged = 0
        for batch in batches:
            for w in column_words(batch.column(1)):
                t = shingle_sets(w, k)[2]
                tokens.append(t), counts.append(np.ones(len(t), np.int64))
                if sum(map(len, tokens[1:])) >= max(_FLUSH_ENTRIES, merged):
                    one = _merged(tokens, counts)
                    tokens[:], counts[:], merged = [one[0]], [one[1]], len(one[0])
                    if merged >= _FLUSH_ENTRIES:
                        yield give()
                        merged = 0
        if sum(map(len, tokens)):
            one = _merged(tokens, counts)
            tokens[:], counts[:] = [one[0]], [one[1]]
            yield give()

    return work


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of a range of shingles: those that more than one text has."""
    tokens, counts = [], []
    for batch in batches:
        tokens += [np.frombuffer(t, np.uint32) for t in batch.column(1).to_pylist()]
        counts += [_unplanes(n) for n in batch.column(2).to_pylist()]
    if tokens:
        token, n = _merged(tokens, counts)
        yield pa.RecordBatch.from_arrays([pa.array(token[n > 1].astype(np.int64)), pa.array(n[n > 1])], names=["token", "n"])


def shingle_order(texts: DataFrame, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, bool]:
    """(sorted shingles, how many texts have each, whether these are all) of the shingles that more than one text has,
    counted over all texts; where they are more than ORDERED, only the most frequent. It decides how fast the comparison
    is, not what it finds."""
    spark, parts = texts.sparkSession, partitions_for(texts)
    path = shared_path(spark, "shingles")  # read more than once
    texts.mapInArrow(_counted(k, parts), "part int, tokens binary, counts binary").repartitionById(parts, "part").mapInArrow(_repeated, "token bigint, n bigint").write.parquet(path)
    counted = spark.read.schema("token bigint, n bigint").parquet(path)
    rows = counted.limit(ORDERED + 1).toArrow()
    whole = rows.num_rows <= ORDERED
    if not whole:  # only the most frequent ones, of equally frequent ones all or none
        left, cut = ORDERED, 1 << 62
        for n, tokens in sorted(((r.n, r.tokens) for r in counted.groupBy("n").agg(F.count(F.lit(1)).alias("tokens")).collect()), reverse=True):
            left -= tokens
            if left < 0:
                break
            cut = n
        rows = counted.where(F.col("n") >= cut).toArrow()
    drop_path(spark, path)
    token, n = (rows.column(c).to_numpy() for c in ("token", "n"))
    at = np.argsort(token)
    return token[at].astype(np.uint32), n[at], whole


def _entries(parts: int, order: tuple[np.ndarray, np.ndarray], t: Fraction, hot: int):
    """Prefixes packed per part: 16-bit keys (shingles that share one only bring more to compare) and largest partners
    of the entries, and once for each class its ref, size, number of entries and signature, in order of size."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def give() -> pa.RecordBatch:
            base = np.cumsum([0] + [len(h[3]) for h in held])
            own = np.concatenate([h[0] + f for h, f in zip(held, base)])
            key, most, ref, size = (np.concatenate([h[i] for h in held]) for i in range(1, 5))
            bits, row, sig = signature_bits(size), np.zeros(len(size), np.int64), {}
            for b in np.unique(bits).tolist():
                row[bits == b] = np.arange((bits == b).sum())
                sig[b] = np.concatenate([h[5][b] for h in held if b in h[5]])
            held.clear()
            h = mix(key.astype(np.uint64) + np.uint64(1))
            part, key = (h % np.uint64(parts)).astype(np.int64), (h >> np.uint64(48)).astype(np.uint16)
            sort = np.lexsort((own, size[own], part))  # runs of equal sizes take no room
            own, key, most = own[sort], key[sort], most[sort]
            edge = np.searchsorted(part[sort], np.arange(parts + 1))
            rows = []
            for p in np.flatnonzero(np.diff(edge)).tolist():
                a, z = edge[p], edge[p + 1]
                at = np.flatnonzero(np.r_[True, own[a + 1 : z] != own[a : z - 1]])
                c = own[a:z][at]
                signs = b"".join(sig[b][row[c[bits[c] == b]]].tobytes() for b in np.unique(bits[c]).tolist())
                rows.append((p, key[a:z].tobytes(), most[a:z].tobytes(), _planes(ref[c], 5), _planes(size[c]), _planes(np.diff(np.r_[at, z - a])), signs))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i else pa.int32()) for i, c in enumerate(zip(*rows))], names=_PART_COLUMNS)

        waiting = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ref = batch.column(0).to_numpy(zero_copy_only=False)
            size, tokens = decode_tokens(batch.column(1), order[0])
            bits, owner = signature_bits(size), np.repeat(np.arange(len(size)), size)
            sig = {b: signatures(size[bits == b], tokens[bits[owner] == b], b) for b in np.unique(bits).tolist()}
            own, key, most = prefixes(size, tokens, order, t, hot)
            held.append((own, key, pack_most(most, size[own], t), ref, size, sig))
            waiting += len(own)
            if waiting >= _FLUSH_ENTRIES:
                yield give()
                waiting = 0
        if waiting:
            yield give()

    return work


_PART_COLUMNS = ["part", "bucket_keys", "partners", "refs", "sizes", "times", "signs"]
_PART = "part int, " + ", ".join(f"{c} binary" for c in _PART_COLUMNS[1:])


def _unpacked(rows: list[tuple[bytes, ...]], t: Fraction) -> tuple[np.ndarray, ...]:
    """(key, largest partner, class) of a part's entries, (ref, size, signatures) of its classes."""
    keys, mosts, refs, sizes, owns, signs, begun = [], [], [], [], [], {}, 0
    for packed, partners, ref, size, times, sig in rows:
        n = _unplanes(size)
        own = np.repeat(np.arange(len(n)), _unplanes(times))
        keys.append(np.frombuffer(packed, np.uint16))
        mosts.append(unpack_most(np.frombuffer(partners, np.uint8), n[own], t))
        refs.append(_unplanes(ref, 5)), sizes.append(n), owns.append(own + begun)
        bits, at = signature_bits(n), 0
        for b in np.unique(bits).tolist():
            which = np.flatnonzero(bits == b)
            words = len(which) * (b // 64)
            signs.setdefault(b, []).append((which + begun, np.frombuffer(sig, np.uint64, words, at).reshape(-1, b // 64)))
            at += 8 * words
        begun += len(n)
    key, most, own, ref, size = (np.concatenate(x) for x in (keys, mosts, owns, refs, sizes))
    return key, most, own, ref, size, Signatures(size, {b: tuple(map(np.concatenate, zip(*x))) for b, x in signs.items()})


def _buckets(t: Fraction, large: int, over: bool):
    """Of each part: the class pairs of its buckets that tiles and signatures do not rule out; or, with over, the members
    of its buckets over large. A pair may come again from another portion or part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, ...]]] = {}
        for batch in batches:
            for p, *row in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(p, []).append(row)
        for p in list(held):
            key, most, own, ref, size, sig = _unpacked(held.pop(p), t)
            population = sig.population()
            sort = np.argsort((key.astype(np.uint64) << np.uint64(48)) | (np.minimum(size, (1 << 32) - 1)[own].astype(np.uint64) << np.uint64(16)) | np.minimum(population, 0xFFFF)[own].astype(np.uint64))
            key, most, own = key[sort], most[sort], own[sort]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            held_by = np.diff(np.r_[start, len(key)])
            if over:
                for s, m in zip(start[held_by > large], held_by[held_by > large]):
                    for at in range(s, s + m, 100_000):
                        x = ref[own[at : min(at + 100_000, s + m)]]
                        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(np.full(len(x), (p << 32) | int(key[s]))), pa.array(np.full(len(x), m))], names=["ref", "bucket", "size"])
                continue
            fit = np.repeat(held_by <= large, held_by)
            o = own[fit]
            waiting: list[np.ndarray] = []

            def give() -> pa.RecordBatch:
                both = np.unique(np.concatenate(waiting))
                waiting.clear()
                x, y = ref[(both >> np.uint64(32)).astype(np.int64)], ref[(both & np.uint64(0xFFFFFFFF)).astype(np.int64)]
                return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

            for i, j in tile_pairs(key[fit], size[o], population[o], most[fit], t):
                x, y = o[i], o[j]
                x, y = sig.near(x, y, radius(size[x], size[y], t))
                waiting.append((np.minimum(x, y).astype(np.uint64) << np.uint64(32)) | np.maximum(x, y).astype(np.uint64))
                if sum(map(len, waiting)) >= _CHUNK_PAIRS:
                    yield give()
            if waiting:
                yield give()

    return work


def _sizes(t: Fraction):
    """Class of set sizes: sets more than one apart in it cannot be similar."""
    step = float(np.log(t.denominator / t.numerator))
    return lambda n: np.floor(np.log(np.maximum(n, 1)) / step + 1e-9).astype(np.int64)


def _deal(t: Fraction, known: np.ndarray):
    """Members of large buckets to the tile pairs they belong to; tiles hold sets of like size."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = _sizes(t)
        for batch in batches:
            rows = []
            n, tokens = decode_tokens(batch.column(4), known)
            sig = [x.tobytes() for x in signatures(n, tokens, DEALT_BITS)]
            lv = level(n)
            for bucket, size, h1, h2, n, sig, own in zip(*(c.to_pylist() for c in batch.columns[:4]), n.tolist(), sig, lv.tolist()):
                slots = -(-size // SIDE)
                slot = (h2 & 0x7FFFFFFF) % slots
                for other in (own - 1, own, own + 1):
                    for s in range(slots):
                        x, y = sorted([(own, slot), (other, s)])
                        rows.append((f"{bucket}/{x[0]}.{x[1]}/{y[0]}.{y[1]}", (own, slot) == x, (own, slot) == y, h1, h2, n, sig))
                        if len(rows) >= 20_000:
                            yield _dealt(rows)
                            rows = []
            if rows:
                yield _dealt(rows)

    return work


#: Width of the signatures of dealt classes, which are compared without regard to their sizes.
DEALT_BITS = 512
_DEALT = "unit string, left boolean, right boolean, h1 bigint, h2 bigint, n int, signature binary"


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["unit", "left", "right", "h1", "h2", "n", "signature"])


def _tiles(t: Fraction):
    """Compare the two squares of each unit tile by tile; rows of a unit come together."""

    STRIDE = 512

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def give() -> pa.RecordBatch | None:
            left, right = [r for r in held if r[1]], [r for r in held if r[2]]
            if not left or not right:
                return None
            n = lambda side: np.array([r[5] for r in side], np.int64)
            sig = lambda side: np.frombuffer(b"".join(r[6] for r in side), np.uint64).reshape(len(side), -1)
            same = all(r[1] and r[2] for r in held)
            sig_a, n_a, sig_b, n_b = sig(left), n(left), sig(right), n(right)
            ref_a, ref_b = (refs_of(np.array([r[3] for r in side], np.int64)) for side in (left, right))
            found = []
            for u in range(0, len(left), STRIDE):
                for v in range(u if same else 0, len(right), STRIDE):
                    x, y = slice(u, u + STRIDE), slice(v, v + STRIDE)
                    i, j = compare_tiles(sig_a[x], n_a[x], sig_b[y], n_b[y], t, same and u == v)
                    found.append((ref_a[i + u], ref_b[j + v]))
            a, b = (np.concatenate(c) for c in zip(*found))
            if not len(a):
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != unit:
                    if held and (out := give()):
                        yield out
                    unit, held = row[0], []
                held.append(row)
        if held and (out := give()):
            yield out

    return work


def _exact(t: Fraction, known: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                (n_a, tok_a), (n_b, tok_b) = (decode_tokens(part.column(part.schema.get_field_index(c)), known) for c in ("tokens_a", "tokens_b"))
                pair = np.arange(part.num_rows, dtype=np.uint64) << np.uint64(32)
                both = np.sort(np.concatenate([np.repeat(pair, n_a) | tok_a, np.repeat(pair, n_b) | tok_b]))
                common = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=part.num_rows)
                good = np.flatnonzero(similar(common, n_a, n_b, t))
                if len(good):
                    yield part.select(["a1", "a2", "b1", "b2"]).take(pa.array(good))

    return work


def class_links(texts: DataFrame, t: Fraction = SIMILARITY, k: int = SHINGLE, large: int = LARGE) -> DataFrame:
    """(a1, a2, b1, b2): pairs of different classes of texts (id, text) whose similarity is t or more, each once."""
    parts, (known, often, _) = partitions_for(texts), shingle_order(texts, k)
    order = (known, often)
    # The joins below imply these filters; stated here, they leave the exchange the same for every use.
    told = texts.mapInArrow(_classes(k, known), _CLASS).where("ref is not null and h1 is not null and h2 is not null")
    classes = told.repartition(parts, "ref").groupBy("ref", "h1", "h2").agg(F.first("body").alias("body"))
    entries = classes.select("ref", "body").mapInArrow(_entries(parts, order, t, large), _PART).repartitionById(parts, "part")
    found = entries.mapInArrow(_buckets(t, large, False), "a bigint, b bigint")
    dealt = (
        entries.mapInArrow(_buckets(t, large, True), "ref bigint, bucket bigint, size bigint").join(classes, "ref")
        .select("bucket", "size", "h1", "h2", "body").mapInArrow(_deal(t, known), _DEALT)
        .repartition(parts, "unit").sortWithinPartitions("unit").mapInArrow(_tiles(t), "a bigint, b bigint")
    )
    # Dealt by b, the pairs are made distinct and joined where the classes already lie.
    pairs = found.unionByName(dealt).repartition(parts, "b").distinct()
    # Refs that two classes share only bring both along; hashes in full decide at the end.
    found = (
        pairs.join(classes.select(F.col("ref").alias("b"), F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("body").alias("tokens_b")), "b")
        .select("a", "b1", "b2", "tokens_b")
        .join(classes.select(F.col("ref").alias("a"), F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("body").alias("tokens_a")), "a")
        .where((F.col("a1") != F.col("b1")) | (F.col("a2") != F.col("b2")))
        .select("a1", "a2", "b1", "b2", "tokens_a", "tokens_b")
        .mapInArrow(_exact(t, known), "a1 bigint, a2 bigint, b1 bigint, b2 bigint")
    )
    turn = (F.col("a1") > F.col("b1")) | ((F.col("a1") == F.col("b1")) & (F.col("a2") > F.col("b2")))
    return found.select(*[F.when(turn, F.col(y + i)).otherwise(F.col(x + i)).alias(x + i) for x, y in ("ab", "ba") for i in "12"]).distinct()


def near_duplicates(texts: DataFrame, t: Fraction = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of rows of texts (id long, text) whose k-word shingle sets have t of their
    union in common.

    Null and empty texts, those under k words and rows without an id form no pair; rows that repeat an id form none with each other; an
    empty table gives none; texts of any length count whole. Copies are joined as one class and only spread out into
    pairs at the end, so a class that holds a third of all rows costs one row per task until then.
    """
    texts = spread(texts.where("id is not null").select(F.col("id").cast("bigint").alias("id"), "text"))
    members = texts.mapInArrow(_members(k), "id bigint, h1 bigint, h2 bigint").where("h1 is not null and h2 is not null")
    of = lambda s: members.select(F.col("h1").alias(s + "1"), F.col("h2").alias(s + "2"), F.col("id").alias("id_" + s))
    copies = of("a").join(of("b"), (F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2"))).where("id_a < id_b").select("id_a", "id_b")
    links = class_links(texts, t, k).join(of("a"), ["a1", "a2"]).join(of("b"), ["b1", "b2"]).where("id_a != id_b")
    return links.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).unionByName(copies)


def near_duplicate_classes(texts: DataFrame, t: Fraction = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """(id, class_id, links): each row of texts (id long, text) of k words or more with the class of its shingle set, named
    by the lowest id in it, and the number of other classes that are similar to it.

    For large collections: nothing is multiplied within a class, whatever share of the rows it holds. Its map-side
    aggregation reduces copies before they are shuffled. Other conditions are those of near_duplicates.
    """
    texts = spread(texts.where("id is not null").select(F.col("id").cast("bigint").alias("id"), "text"))
    members = texts.mapInArrow(_members(k), "id bigint, h1 bigint, h2 bigint")
    named = members.groupBy("h1", "h2").agg(F.min("id").alias("class_id"))
    links = class_links(texts, t, k)
    ends = links.select(F.explode(F.array(F.struct(F.col("a1").alias("h1"), F.col("a2").alias("h2")), F.struct(F.col("b1").alias("h1"), F.col("b2").alias("h2")))).alias("e"))
    n = ends.groupBy("e.h1", "e.h2").agg(F.count(F.lit(1)).alias("links"))
    classes = named.join(n, ["h1", "h2"], "left").withColumn("links", F.coalesce("links", F.lit(0)))
    return members.join(classes, ["h1", "h2"]).select("id", "class_id", "links")
