"""Phrase collocations: longest windows counted once, shorter phrases by ROLLUP.

Each word position gives one window: the word and the next three by lead
columns, padded with '' from the end of its piece on. Only these longest
windows are counted; ``rollup(lang, w1, w2, w3, w4)`` then sums them to every
shorter phrase (a phrase of k words is a prefix of exactly the windows that
start at its occurrences) and, without words, to the language's total.

Before that, windows are cut where no phrase of ``least`` occurrences can go on:
words and pairs, then the triples of such pairs, are counted over all texts by
64-bit hashes, and what stays below ``least`` ends the window there. A hash
counts at least what falls into it, so no phrase that could count is lost;
hashes shared by chance only leave windows longer. Tasks get the frequent
hashes as a bitmap of 16 cells a hash, of 2^MOST_BITS cells (8 MB) at most;
were there more frequent pairs than cells, windows would stay longer, the
counts the same.

Defined cases: null text is empty, null lang is ``und`` (with the lang of that
name); words keep any character but those that split; a language without words,
and an empty table, give no row; repeated rows count as often as they stand
there; columns other than lang and text are ignored. Texts are read whole; a
text is the least unit of a task's memory. Ties go by score, then count, then
the phrase's UTF-8 bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm.common import checkpoint

#: Cells of the bitmap at most, and those that one row carries.
MOST_BITS, CHUNK_BITS = 26, 16
#: Text bytes that a task holds as word numbers at a time.
BLOCK_BYTES = 6 << 20
WORDS = ["w1", "w2", "w3", "w4"]
#: Odd multipliers of the hash of neighbouring words.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

#: A piece ends at these marks; a tab divides words like a space.
_MARKS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")


def words_of(text: str | None) -> list[bytes]:
    """Words in order, a newline wherever a piece ends (also at the end)."""
    data = (text or "").encode().lower().translate(_MARKS).replace(b"\n", b" \n ")  # bytes.lower: A-Z only
    return [w for w in data.split(b" ") if w] + [b"\n"]


def _blocks(batches: Iterator, most: int) -> Iterator[tuple[str, list[bytes], object]]:
    """(lang, vocabulary, word numbers) of about ``most`` bytes of text; number 0 ends a piece."""
    from collections import defaultdict

    import numpy as np

    def flush(held: dict):
        for lang, (vocabulary, parts) in held.items():
            yield lang, list(vocabulary), np.concatenate(parts)

    held: dict = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            lang, text = lang.as_py(), text.as_py()
            if lang not in held:
                vocabulary: defaultdict = defaultdict()
                vocabulary.default_factory = vocabulary.__len__
                vocabulary[b"\n"]
                held[lang] = (vocabulary, [])
            vocabulary, parts = held[lang]
            words = words_of(text)
            parts.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
            size += len(text or "")
            if size >= most:
                yield from flush(held)
                held, size = {}, 0
    yield from flush(held)


def _runs(lang: str, vocabulary: list[bytes], words, bitmaps: list[bytes]) -> list[tuple]:
    """For runs of one, two and three words: the hash of the run at each position and whether
    it may be frequent, all that ``bitmaps`` (of words and pairs, of triples) can tell."""
    import numpy as np
    import xxhash

    def known(hashes, bitmap):
        bits = np.unpackbits(np.frombuffer(bitmap, np.uint8)).view(bool)
        return bits[hashes >> np.uint64(65 - len(bits).bit_length())]

    seed = zlib.crc32(lang.encode())
    h = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in vocabulary), np.uint64, len(vocabulary))
    found, n = [], len(words)
    for size in (1, 2, 3):
        name = sum((h * np.uint64(m))[words[k : max(k, n - size + 1 + k)]] for k, m in enumerate(MULTIPLIERS[:size])) if size > 1 else h[words]
        name = np.append(name, np.zeros(size - 1, np.uint64))[:n]
        if size == 1:
            may = words > 0
        else:
            before = found[-1][1]
            may = before & np.append(before[1:], False)
        at = 0 if size < 3 else 1
        if len(bitmaps) > at:
            may &= known(name, bitmaps[at])
        found.append((name, may))
    return found


def _frequent_hashes(docs: DataFrame, least: int, bitmaps: list[bytes]) -> DataFrame:
    """(key): the hashes that words or pairs (with a bitmap of these: triples) of ``least`` occurrences fall into."""
    import pyarrow as pa

    block = BLOCK_BYTES

    def count(batches):
        import numpy as np

        for lang, vocabulary, words in _blocks(batches, block):
            runs = _runs(lang, vocabulary, words, bitmaps)
            runs = runs[2:] if bitmaps else runs[:2]
            keys, n = np.unique(np.concatenate([name[may] for name, may in runs]), return_counts=True)
            for at in range(0, len(keys), 65536):
                yield pa.record_batch([pa.array(keys[at : at + 65536].view(np.int64)), pa.array(n[at : at + 65536])], ["key", "n"])

    counts = docs.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return checkpoint(counts.where(F.col("n") >= least).select("key"))


def _bitmap(keys: DataFrame) -> bytes:
    """One bit a cell, a power of two of cells: whether the upper bits of a key name it."""
    import pyarrow as pa

    bits = min(MOST_BITS, max(CHUNK_BITS, (16 * keys.count()).bit_length()))
    chunk = 1 << CHUNK_BITS

    def merge(batches):
        import numpy as np

        found: dict[int, object] = {}
        for batch in batches:
            cells = batch.column(0).to_numpy()
            for k in np.unique(cells // chunk).tolist():
                found.setdefault(k, np.zeros(chunk, bool))[cells[cells // chunk == k] % chunk] = True
        for k, part in found.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([np.packbits(part).tobytes()], pa.binary())], ["chunk", "bits"])

    cells = keys.select(F.shiftrightunsigned("key", 64 - bits).alias("cell"))
    parts = cells.repartition(F.floor(F.col("cell") / chunk)).mapInArrow(merge, "chunk int, bits binary")
    found = {r["chunk"]: r["bits"] for r in parts.collect()}  # a bit a cell
    return b"".join(found.get(k, bytes(chunk // 8)) for k in range(1 << (bits - CHUNK_BITS)))


def _windows(docs: DataFrame, bitmaps: list[bytes]) -> DataFrame:
    """(lang, w1..w4, n): padded longest windows counted by block; a window without words
    counts the positions whose word is too rare to start a phrase."""
    import pyarrow as pa

    block = BLOCK_BYTES
    schema = pa.schema([("lang", pa.string()), *[(w, pa.string()) for w in WORDS], ("n", pa.int64())])

    def count(batches):
        import numpy as np

        for lang, vocabulary, words in _blocks(batches, block):
            (_, one), (_, two), (_, three) = _runs(lang, vocabulary, words, bitmaps)
            lead = lambda k: np.concatenate([words[k:], np.zeros(min(k, len(words)), np.int32)])  # noqa: B023, E731
            four = three & np.append(three[1:], False)
            windows = [np.where(on, lead(k), 0) for k, on in enumerate((one, two, three, four))]
            longer = windows[1] > 0
            alone = np.bincount(windows[0][~longer], minlength=len(vocabulary))
            alone[0] -= np.count_nonzero(words == 0)
            columns = [c[longer].astype(np.int64) for c in windows]
            size = len(vocabulary)
            front, front_at = np.unique(columns[0] * size + columns[1], return_inverse=True)
            back, back_at = np.unique(columns[2] * size + columns[3], return_inverse=True)
            both, n = np.unique(front_at * max(1, len(back)) + back_at, return_counts=True)
            f, b = front[both // max(1, len(back))], back[both % max(1, len(back))]
            kept = np.flatnonzero(alone)
            numbers = [np.concatenate([kept, f // size]), np.concatenate([np.zeros_like(kept), f % size]),
                       np.concatenate([np.zeros_like(kept), b // size]), np.concatenate([np.zeros_like(kept), b % size])]
            names = pa.array([""] + [w.decode() for w in vocabulary[1:]], pa.string())
            out = pa.record_batch([pa.array([lang] * len(numbers[0]), pa.string()), *[names.take(pa.array(x)) for x in numbers],
                                   pa.array(np.concatenate([alone[kept], n]), pa.int64())], schema=schema)
            for at in range(0, out.num_rows, 65536):
                yield out.slice(at, 65536)

    return docs.mapInArrow(count, "lang string, w1 string, w2 string, w3 string, w4 string, n long")


def phrase_counts(docs: DataFrame, least: int = 30) -> DataFrame:
    """(lang, words, f) of all phrases of one to four words with f >= ``least``, and
    for each language a row without words with all its word occurrences."""
    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    bitmaps = [_bitmap(_frequent_hashes(source, least, []))]
    bitmaps.append(_bitmap(_frequent_hashes(source, least, bitmaps)))
    counted = _windows(source, bitmaps).groupBy("lang", *WORDS).agg(F.sum("n").alias("n"))
    rolled = counted.rollup("lang", *WORDS).agg(F.sum("n").alias("f"), F.grouping_id().alias("out"))
    last = F.col("w1")  # of the words that a level keeps, the last is no padding
    for w in WORDS[1:]:
        last = F.coalesce(F.col(w), last)
    words = F.filter(F.array(*WORDS), lambda w: w.isNotNull())
    level = rolled.where("lang IS NOT NULL").where((F.col("out") == 15) | ((last != "") & (F.col("f") >= least)))
    return checkpoint(level.select("lang", words.alias("words"), "f").where("f > 0"))


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000) -> DataFrame:
    """The first ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score."""
    counts = phrase_counts(docs, least).withColumn("m", F.size("words"))
    totals = counts.where("m = 0").select("lang", F.col("f").alias("n"))
    known = counts.where("m > 0").select("lang", _joined(F.col("words")).alias("phrase"), "words", "m", "f")
    longer = F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("m") - size + 1), lambda at: F.array_join(F.slice("words", at, size), " "))))
    inside = (known.where("m > 2").select("lang", F.explode(longer).alias("phrase"), "f")
              .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))

    cuts = known.where("m > 1").select("lang", "phrase", F.col("f").alias("a"), "words", "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.slice("words", F.lit(1), F.col("k"))).alias("left"),
                       _joined(F.slice("words", F.col("k") + 1, F.col("m") - F.col("k"))).alias("right"))
    cuts = (cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
            .join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]))
    # Decimal: the product may pass 64 bits.
    score = F.expr("(CAST(2000000 AS DECIMAL(10, 0)) * CAST(a AS DECIMAL(20, 0))) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    kept = best.join(inside, ["lang", "phrase"], "left").where("longer IS NULL OR 100 * longer < 80 * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
