"""Best-fit packing by a configuration linear program over the length histogram.

Documents are tokenised once; the pieces (no text) are written, equal ones as
blocks with a count, and counted by length. Only that histogram (2048 counts at most) reaches the driver. The
covering program  min sum x_c  with  sum_c a_cl x_c >= n_l  over all multisets
c of lengths that fit a sequence is solved by multiplicative weights: weights
y_l fall as length l gets covered, and the next configurations are the best
knapsacks under these weights (dynamic program over 0..capacity), until every length
is covered. The fractional solution is rounded and the program solved again for
what the rounding leaves; the last pieces, one in 20 at most, fill the room left, best
fit first. The plan is a list of groups of sequences with equal contents; its size depends
on the capacity alone. Each piece finds its place from its rank among the
pieces of its length.

Null text counts as empty: one piece of length 1 (id 0). Repeated rows are
packed each, however many are equal. An empty table gives no rows. Extra columns are not read. White
space other than blanks and newlines stays inside a cached word and is left to
the tokenizer, so ids equal those of the whole text.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm.common import checkpoint, counted, shuffle_partitions, slices, unfolded

CAPACITY = 2048
#: Rate at which weights fall, and the share of the best price that a step may lack.
ETA, NEAR = 0.3, 0.005
#: One piece in so many at most is left to best-fit decreasing.
SHARE = 20
#: Words whose ids a task keeps; a cache only, what is not in it is encoded again.
CACHE_WORDS = 250_000
#: Texts that are looked up together.
TEXTS = 256
#: Marks that the pattern parts from the letters before them (no apostrophe: contractions are words of their own).
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The byte alphabet of the model: printable Latin-1 characters stand for themselves,
#: the other bytes for the characters from U+0100 on, in order. Blanks part runs here.
_PRINTED = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
_ALPHABET = {b: 0x100 + k for k, b in enumerate(x for x in range(256) if x not in _PRINTED)} | {0x20: 0x20}

#: (contents [(length, copies)], sequences with these contents).
Groups = list[tuple[list[tuple[int, int]], int]]

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Ids of whole texts as packed little-endian uint32.

    The tokenizer's pattern never joins across white space and its normaliser
    (NFC, lower case) works within words, so the ids of a text are those of its
    words in turn; words repeat, so their ids are kept. The pattern also parts a
    run of letters from the marks behind it, so a word of Latin letters and marks
    is the ids of its lower-cased letters and those of its marks. New runs of
    letters are encoded together, as one text of words; a run's last id is one
    that ends a word.
    """

    def __init__(self, path: str | None = None, cache_words: int | None = None) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # The same model over runs of letters that are already in its byte alphabet.
        self.bare = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.words, self.letters = _Kept(cache_words or CACHE_WORDS), _Kept(cache_words or CACHE_WORDS)

    def _single(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _runs(self, runs: list[str]) -> None:
        """Keeps the ids of lower-case runs of letters."""
        for at in range(0, len(runs), 4000):
            part = runs[at : at + 4000]
            text = " ".join(part)
            if not text.isascii():
                text = text.encode().decode("latin-1").translate(_ALPHABET)
            ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(ends) != len(part):
                raise ValueError("a run of letters has several words")
            packed = ids.tobytes()
            self.letters.new.update(zip(part, map(packed.__getitem__, map(slice, [0, *ends], ends))))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        words = [t.replace("\n", " ").split(" ") for t in texts]
        known, runs = self.words.turn(), self.letters.turn()
        whole, cores, marks = [], [], []
        for w in self.words.missing(set().union(*words)):
            core = w.rstrip(_MARKS)
            if core.isalpha() and (w.isascii() or (max(core) < "\u0250" and "\u0130" not in core)):
                whole.append(w)
                cores.append(core.lower())
                marks.append(w[len(core):])
            else:
                known[w] = self._single(w)
        self._runs(list(self.letters.missing(set(cores))))
        behind = {m: self._single(m) if m else b"" for m in set(marks)}
        known.update(zip(whole, map(bytes.__add__, map(runs.__getitem__, cores), map(behind.__getitem__, marks))))
        get = known.__getitem__
        for ws in words:
            yield b"".join(map(get, ws))


class _Kept:
    """A bounded memory of ids by text: the last ``most`` new entries, and those used since."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def turn(self) -> dict[str, bytes]:
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        return self.new

    def missing(self, texts: set[str]) -> set[str]:
        texts = texts.difference(self.new)
        out = texts.difference(self.old)
        for t in texts.difference(out):
            self.new[t] = self.old[t]
        return out


_WORD_IDS: dict[tuple, WordIds] = {}


def word_ids(path: str | None, cache_words: int | None = None) -> WordIds:
    key = path, cache_words
    if key not in _WORD_IDS:
        _WORD_IDS.clear()  # a worker keeps one
        _WORD_IDS[key] = WordIds(path, cache_words)
    return _WORD_IDS[key]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, cache_words: int | None = None) -> DataFrame:
    """Every document's pieces: ids, then id 0, cut only where longer than ``capacity``;
    ``cache_words`` bounds the memory of a task for the price of time, results are the same."""

    def run(batches):
        coder = word_ids(path, cache_words)
        for batch in batches:
            for part in slices(batch, TEXTS):
                rows: list[tuple] = []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), coder.encode(texts)):
                    ids += b"\0\0\0\0"
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        one = ids[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(one) // 4, zlib.crc32(one)))
                cols = list(zip(*rows))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


# --- the plan ---------------------------------------------------------------


def knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for every capacity 0..capacity, and the length taken last (0: none);
    ``value`` by length, -inf where there is none."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    value = value[1:]
    for c in range(1, capacity + 1):
        got = best[c - 1 :: -1] + value[:c]
        k = int(got.argmax())
        if got[k] > best[c - 1]:
            best[c], last[c] = got[k], k + 1
        else:
            best[c] = best[c - 1]
    return best, last


def trace(last: np.ndarray, capacity: int) -> dict[int, int]:
    """The configuration (length: copies) behind the best value for ``capacity``."""
    out: dict[int, int] = defaultdict(int)
    while capacity > 0:
        k = int(last[capacity])
        if k:
            out[k] += 1
        capacity -= k or 1
    return out


def solve(hist: dict[int, int], capacity: int = CAPACITY, eta: float = ETA, near: float = NEAR) -> tuple[dict[tuple, float], float]:
    """Fractional solution {configuration: sequences} that covers every length exactly,
    and a lower bound of the program (its best dual value).

    A round prices once: the knapsack table holds the best configuration with each open
    length, too. Of these, all within ``near`` of the best are taken, until one of their
    lengths is covered; so a step covers at least one length, the solution has at most
    as many configurations as lengths, and the rounds end when all are covered.
    """
    need = np.zeros(capacity + 1)
    for length, n in hist.items():
        need[length] = n
    size, left, x, bound, rounds = np.arange(capacity + 1.0), need.copy(), defaultdict(float), 0.0, 0
    while (left > 0).any():
        y = size * np.exp(-eta * (1 - left / np.maximum(need, 1)))
        if rounds % 20 == 0:  # any weights give a bound: y over the best configuration's value is dual feasible
            bound = max(bound, float((y * need).sum() / knapsack(np.where(need > 0, y, -np.inf), capacity)[0][capacity]))
        rounds += 1
        # Pricing over what is still open, so that no length is covered twice.
        best, last = knapsack(np.where(left > 0, y, -np.inf), capacity)
        lengths = np.flatnonzero(left > 0)
        gain = y[lengths] + best[capacity - lengths]
        order = np.argsort(-gain, kind="stable")
        for length in lengths[order[gain[order] >= (1 - near) * gain.max()]].tolist():
            config = trace(last, capacity - length)
            config[length] += 1
            step = min(left[k] / a for k, a in config.items())
            if step <= 0:
                continue
            x[tuple(sorted(config.items(), reverse=True))] += step
            for k, a in config.items():
                left[k] -= step * a
                if left[k] < 1e-9 * need[k]:
                    left[k] = 0
    return dict(x), bound


def rounded(x: dict[tuple, float], left: dict[int, int]) -> list[tuple[list[tuple[int, int]], int]]:
    """Whole sequences of the configurations of ``x``, taken out of ``left``: first their
    whole parts, then one more of each that what is left still holds, largest
    remainders of at least a half first, then the fullest; one, less what is missing,
    if there are none."""
    got: dict[tuple, int] = defaultdict(int)

    def take(config: tuple, most: int) -> None:
        m = min(most, *(left.get(k, 0) // a for k, a in config))
        if m > 0:
            got[config] += m
            for k, a in config:
                left[k] -= m * a

    order = sorted(x, key=lambda c: (-sum(k * a for k, a in c), -x[c], c))
    for config in order:
        take(config, int(x[config] + 1e-9))
    for config in sorted(order, key=lambda c: -(x[c] % 1)):
        if x[config] % 1 >= 0.5:
            take(config, 1)
    for config in order:
        take(config, 1)
    if not got:
        take(tuple((k, min(a, left[k])) for k, a in order[0]), 1)
    for k in [k for k, n in left.items() if not n]:
        del left[k]
    return [(list(c), m) for c, m in got.items()]


def best_fit_decreasing(hist: dict[int, int], capacity: int, started: Groups = ()) -> Groups:
    """Best-fit decreasing on counts, into the room of ``started`` first: groups
    (contents [(length, copies)], sequences)."""
    open_: dict[int, Groups] = defaultdict(list)
    for contents, m in started:
        open_[capacity - sum(k * a for k, a in contents)].append((contents, m))
    for length in sorted(hist, reverse=True):
        n = hist[length]
        rooms = sorted(r for r in open_ if r >= length and open_[r])
        for room in rooms:
            fit = room // length
            groups, open_[room] = open_[room], []
            for contents, m in groups:
                full = min(m, n // fit)
                if full:
                    open_[room - fit * length].append((contents + [(length, fit)], full))
                    n, m = n - full * fit, m - full
                if m and n:  # one sequence takes what is left of this length
                    open_[room - n * length].append((contents + [(length, n)], 1))
                    n, m = 0, m - 1
                if m:
                    open_[room].append((contents, m))
            if not n:
                break
        per = capacity // length
        if n // per:
            open_[capacity - per * length].append(([(length, per)], n // per))
        if n % per:
            open_[capacity - n % per * length].append(([(length, n % per)], 1))
    return [g for room in open_.values() for g in room]


def plan(hist: dict[int, int], capacity: int = CAPACITY, share: int = SHARE) -> tuple[Groups, float]:
    """Groups of sequences that hold every length of ``hist`` exactly, and the lower
    bound of the program plus the full sequences. Solved and rounded again for what the
    rounding leaves, until that is at most one piece in ``share``; best-fit decreasing
    puts these into the room that is left. Plain best-fit decreasing is taken only where it
    needs fewer sequences."""
    left = {int(k): int(v) for k, v in hist.items() if v}
    plain = best_fit_decreasing(left, capacity)
    full = left.pop(capacity, 0)
    groups: Groups = [([(capacity, 1)], full)] if full else []
    total, bound = sum(left.values()), 0.0
    while sum(left.values()) * share > total:
        x, b = solve(left, capacity)
        bound = bound or b
        groups += rounded(x, left)
    groups = best_fit_decreasing(left, capacity, groups)
    return min(groups, plain, key=lambda g: sum(m for _, m in g)), bound + full


def placements(groups: Groups) -> dict[str, np.ndarray]:
    """For ranks first.. of a length: copies in a sequence, first sequence, offset there."""
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for contents, m in groups:
        at = 0
        for length, copies in contents:
            rows.append((length, used[length], copies, base, at))
            used[length] += copies * m
            at += copies * length
        base += m
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "copies", "base", "offset"), table.T))


def ranked_in_length(blocks: DataFrame, hist: dict[int, int]) -> DataFrame:
    """The pieces behind ``blocks`` (of ``counted``) with ``rank_`` from 0 among the pieces
    of a length. A length that many pieces share is split into hashed buckets in proportion
    to its share, and the rank is the bucket's offset plus the rank inside; the offsets
    (lengths + 2 x partitions rows at most) are all that the driver sees. Equal pieces
    are blocks of bounded size and hash apart, too."""
    spark, total = blocks.sparkSession, max(1, sum(hist.values()))
    parts = 2 * shuffle_partitions(blocks)
    split = spark.createDataFrame([(k, 1 + v * parts // total) for k, v in hist.items()] or [(0, 1)], "length long, split_ long")
    order = ["doc_id", "piece", "ids_crc32", "block_"]
    keyed = blocks.join(F.broadcast(split), "length").withColumn("bucket_", F.pmod(F.xxhash64(*order), F.col("split_")))
    counts = sorted(tuple(r) for r in keyed.groupBy("length", "bucket_").agg(F.sum("copies_")).collect())
    offsets, before = [], defaultdict(int)
    for length, bucket, n in counts:
        offsets.append((length, bucket, before[length]))
        before[length] += n
    at = spark.createDataFrame(offsets or [(0, 0, 0)], "length long, bucket_ long, before_ long")
    w = Window.partitionBy("length", "bucket_").orderBy(*order, "start").rowsBetween(Window.unboundedPreceding, 0)
    ranked = keyed.withColumn("through_", F.sum("copies_").over(w)).join(F.broadcast(at), ["length", "bucket_"])
    return unfolded(ranked.withColumn("rank_", F.col("before_") + F.col("through_") - F.col("copies_")), "rank_")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, share: int = SHARE,
                report: Callable[[dict], None] | None = None) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    blocks = checkpoint(counted(pieces.select(names)))
    hist = dict(blocks.groupBy("length").agg(F.sum("copies_")).collect())
    groups, bound = plan(hist, capacity, share)
    if report:
        report({"sequences": sum(m for _, m in groups), "lower_bound": bound, "groups": len(groups)})
    p = placements(groups)
    key = (p["length"] << 42) + p["first"] if len(p["length"]) else np.zeros(0, np.int64)

    def run(batches):
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("rank_").to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, (length << 42) + rank, side="right") - 1
            r, copies = rank - p["first"][at], p["copies"][at]
            out = b.drop_columns(["rank_"])
            yield out.append_column("sequence_id", pa.array(p["base"][at] + r // copies)).append_column(
                "offset", pa.array(p["offset"][at] + r % copies * length))

    ranked = ranked_in_length(blocks, hist).select(*names, "rank_")
    return ranked.mapInArrow(run, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, cache_words: int | None = None, **more) -> DataFrame:
    return pack_pieces(token_pieces(docs, capacity, path, cache_words), capacity, **more)
