"""Toxicity of whole texts: obfuscated words are restored by a noisy channel, then the restored text is scored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm.common import mix, span_hashes, text_blocks, word_spans, write_table

#: What a sign or digit may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c"}
#: Of these, what counts only right before a letter: elsewhere it is punctuation.
PUNCTUATION = "!|+("
#: The channel's costs (in nats): a letter written as a sign; a sign that is one after all, between letters and at an end; a
#: letter repeated three times or more; a letter doubled; a separator without meaning, and one with, next to a single letter
#: and elsewhere.
AS_SIGN, INNER_SIGN, OUTER_SIGN, REPEATED, DOUBLED = 1.0, 6.0, 2.5, 0.5, 2.0
SEPARATED, SEPARATES = {True: 0.5, False: 4.0}, {True: 3.0, False: 0.0}
#: Weights of trigram, bigram, unigram and uniform estimates in the language model.
MIXED = (0.8, 0.15, 0.04, 0.01)
#: Labelled rows that the classifier is fitted on at most (half of them of each label), candidate features, features.
FIT_ROWS, CANDIDATES, FEATURES = 20_000, 200_000, 20_000
#: Toxic rows that a feature needs, times that it must be likelier there, penalty of the weights.
SUPPORT, LIFT, RIDGE = 3, 4.0, 0.05
PREFIXES = range(4, 11)
THRESHOLD = 0.3
BLOCK = 1 << 21
#: Restored units that a task remembers.
REMEMBERED = 200_000

LETTER = np.zeros(256, bool)
LETTER[[*range(97, 123), *range(128, 256)]] = True
SIGNED = np.zeros(256, bool)
SIGNED[[ord(c) for c in LEET]] = True
LATE = np.zeros(256, bool)
LATE[[ord(c) for c in PUNCTUATION]] = True
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Symbols of the language model: 0 is a word's border, the rest are a-z and the bytes of other characters.
SYMBOL = np.zeros(256, np.int64)
SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[128:] = np.arange(27, 155)
N = 155


def units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what may be obfuscated: words with signs or digits next to letters, with a letter three times in a
    row or with single letters between separators, and series of three or more single characters, two of them letters."""
    n = len(data)
    starts, ends, doc = word_spans(data, offs, BLANK)
    if len(starts) == 0:
        return starts, ends
    padded = np.concatenate([[32, 32], data, [32, 32]]).astype(np.uint8)
    at = [padded[i : i + n].copy() for i in range(5)]  # at[2] is the byte itself
    for k in (-2, -1, 1, 2):  # neighbours in another document are blanks
        for border in (offs[1:-1] - k + d for d in range(k)) if k > 0 else (offs[:-1] + d for d in range(-k)):
            border = border[(border >= 0) & (border < n)]
            at[2 + k][border] = 32
    letter = [LETTER[b] for b in at]
    sign = [~(x | BLANK[b]) for x, b in zip(letter, at)]
    odd = SIGNED[data] & (letter[3] | letter[1] & ~LATE[data])
    odd |= (data < 128) & letter[2] & (at[1] == data) & (at[3] == data)
    odd |= letter[2] & sign[1] & sign[3] & (letter[0] | letter[4])
    count = np.concatenate([[0], np.cumsum(odd)])
    hit = count[ends] > count[starts]
    one = (ends - starts == 1) & (LETTER | SIGNED)[data[starts]]
    follows = np.zeros(len(starts), bool)
    follows[1:] = one[1:] & one[:-1] & (doc[1:] == doc[:-1]) & (starts[1:] == ends[:-1] + 1) & (data[ends[:-1]] == 32)
    first = np.flatnonzero(one & ~follows)
    last = np.flatnonzero(one & ~np.concatenate([follows[1:], [False]]))
    letters = np.concatenate([[0], np.cumsum(one & LETTER[data[starts]])])
    series = (last - first >= 2) & (letters[last + 1] - letters[first] >= 2)
    first, last = first[series], last[series]
    inside = np.zeros(len(starts) + 1, np.int64)
    np.add.at(inside, first, 1)
    np.add.at(inside, last + 1, -1)
    hit &= np.cumsum(inside[:-1]) == 0
    s, e = np.concatenate([starts[hit], starts[first]]), np.concatenate([ends[hit], ends[last]])
    order = np.argsort(s)
    return s[order], e[order]


def _options(c: int, run: int, inner: bool, lone: bool) -> list[tuple[tuple[int, ...], float, bytes]]:
    """What ``run`` equal bytes, between letters or signs (``inner``) or next to a ``lone`` one, may stand for: (symbols,
    cost, text)."""
    raw = bytes([c]) * run
    if c >= 128:
        return [((int(SYMBOL[c]),) * run, 0.0, raw)]
    char = chr(c)
    if char in LEET:
        out = [((0,), INNER_SIGN if inner else OUTER_SIGN, raw)]
        for x in LEET[char]:
            out += [(k, cost + AS_SIGN, text) for k, cost, text in _options(ord(x), run, inner, lone)]
        return out
    if not "a" <= char <= "z":
        return [((0,), SEPARATES[lone], raw), ((), SEPARATED[lone], b"")]
    s, one = int(SYMBOL[c]), raw[:1]
    if run == 1:
        return [((s,), 0.0, one)]
    if run == 2:
        return [((s, s), 0.0, raw), ((s,), DOUBLED, one)]
    return [((s,), REPEATED, one), ((s, s), REPEATED, raw[:2])]


def decode(unit: bytes, costs: memoryview) -> bytes:
    """The likeliest reading of a unit: Viterbi over the lattice of what its runs of equal bytes may stand for, where
    ``costs`` has the language model's cost of each three symbols; a path's state is its last two symbols."""
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    cuts = [0, *(i for i in range(1, len(unit)) if unit[i] != unit[i - 1]), len(unit)]
    part = [False, *(bool(LETTER[unit[i]] or SIGNED[unit[i]]) for i in cuts[:-1]), False]  # of a word, by run
    for j in range(1, len(cuts)):
        lone = (part[j - 1] and (j < 3 or not part[j - 2])) or (part[j + 1] and (j + 2 >= len(part) or not part[j + 2]))
        options = _options(unit[cuts[j - 1]], cuts[j] - cuts[j - 1], part[j - 1] and part[j + 1], lone)
        reached: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (x, y), (cost, path) in best.items():
            for symbols, more, text in options:
                a, b, total = x, y, cost + more
                for s in symbols:
                    if s or b:  # a border next to a border is the same one
                        total += costs[(a * N + b) * N + s]
                        a, b = b, s
                if (a, b) not in reached or total < reached[a, b][0]:
                    reached[a, b] = (total, (path, text))
        best = reached
    path = min((cost + (costs[(a * N + b) * N] if b else 0.0), i, path) for i, ((a, b), (cost, path)) in enumerate(best.items()))[2]
    out = []
    while path is not None:
        path, text = path
        out.append(text)
    return b"".join(reversed(out))


def restore(data: np.ndarray, offs: np.ndarray, costs: memoryview, known: dict[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A block of lower-cased texts with every unit replaced by its likeliest reading."""
    starts, ends = units(data, offs)
    if len(starts) == 0:
        return data, offs
    pieces, at, raw = [], 0, data.tobytes()
    grown = np.zeros(len(starts), np.int64)
    for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        unit = raw[s:e]
        text = known.get(unit)
        if text is None:
            if len(known) >= REMEMBERED:
                known.clear()
            known[unit] = text = decode(unit, costs)
        pieces += [raw[at:s], text]
        grown[i] = len(text) - len(unit)
        at = e
    pieces.append(raw[at:])
    shift = np.concatenate([[0], np.cumsum(grown)])
    return np.frombuffer(b"".join(pieces), np.uint8), offs + shift[np.searchsorted(ends, offs, "right")]


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.fill_null("") if column.null_count else column)


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Costs (in nats) of each three symbols, from the trigrams of all texts; units that may be obfuscated don't count.
    A trigram is one of 155 ** 3, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(N**3, np.int64)
        for batch in batches:
            for _, _, data, offs in text_blocks(_lowered(batch.column(0)), BLOCK):
                symbols = SYMBOL[data]
                inside = np.zeros(len(data) + 1, np.int64)
                s, e = units(data, offs)
                np.add.at(inside, s, 1)
                np.add.at(inside, e, -1)
                symbols[np.cumsum(inside[:-1]) > 0] = 0
                doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
                keep = np.concatenate([[True], (symbols[1:] > 0) | (symbols[:-1] > 0)])[: len(data)]
                symbols, doc = symbols[keep], doc[keep]
                one = doc[2:] == doc[:-2]
                counts += np.bincount(((symbols[:-2] * N + symbols[1:-1]) * N + symbols[2:])[one], minlength=N**3)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["k", "c"])

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "k int, c long").groupBy("k").agg(F.sum("c").alias("c")).toArrow()
    counts = np.zeros(N**3)
    counts[rows.column("k").to_numpy()] = rows.column("c").to_numpy()
    three = counts.reshape(N, N, N)
    two = three.sum(axis=0)
    one = two.sum(axis=0)
    w3, w2, w1, w0 = MIXED
    p = w1 * one / max(one.sum(), 1) + w0 / N + w2 * two[None] / np.maximum(two.sum(axis=1), 1)[None, :, None] + w3 * three / np.maximum(three.sum(axis=2), 1)[..., None]
    return (-np.log(p)).astype(np.float32).ravel()


def deobfuscate(docs: DataFrame, costs: np.ndarray | None = None, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` lower-cased and its obfuscated units restored; a null text becomes an empty one."""
    held = docs.sparkSession.sparkContext.broadcast(language_model(docs, text_col) if costs is None else costs)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view, known = memoryview(held.value), {}
        for batch in batches:
            for lo, hi, data, offs in text_blocks(_lowered(batch.column(at)), BLOCK):
                data, offs = restore(data, offs, view, known)
                columns = batch.slice(lo, hi - lo).columns
                columns[at] = pa.StringArray.from_buffers(hi - lo, pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, 64-bit hash) of each word (a run of letters) and of each of its beginnings of 4 to 10 bytes."""
    starts, ends, doc = word_spans(data, offs, ~LETTER)
    docs, keys = [doc], [mix(span_hashes(data, starts, ends) + np.uint64(1))]
    for k in PREFIXES:
        longer = np.flatnonzero(ends - starts > k)
        docs.append(doc[longer])
        keys.append(span_hashes(data, starts[longer], starts[longer] + k))
    return np.concatenate(docs), np.concatenate(keys)


class Picked:
    """A sorted set of feature keys with a bitmap before it, so that most keys are dismissed by one look."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.keys >> np.uint64(42)] = True

    def find(self, doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each pair of document and number of a picked key once."""
        some = np.flatnonzero(self.seen[key >> np.uint64(42)])
        doc, key = doc[some], key[some]
        i = np.searchsorted(self.keys, key)
        hit = i < len(self.keys)
        hit[hit] = self.keys[i[hit]] == key[hit]
        pair = np.unique(doc[hit] * (len(self.keys) + 1) + i[hit])
        return pair // (len(self.keys) + 1), pair % (len(self.keys) + 1)


def _tally(rows: DataFrame, schema: str, per_block) -> DataFrame:
    """``per_block(documents' labels, documents, keys)`` over the features of (text, toxic) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in text_blocks(batch.column(0), BLOCK):
                yield from per_block(toxic[lo:hi], *features(data, offs))

    return rows.mapInArrow(run, schema)


def _logistic(doc: np.ndarray, feature: np.ndarray, y: np.ndarray, m: int) -> np.ndarray:
    """Ridge logistic regression on presence of features, by Newton steps with conjugate gradients; the intercept is last."""
    n = len(y)
    times = lambda w: np.bincount(doc, w[feature], n) + w[-1]
    back = lambda r: np.append(np.bincount(feature, r[doc], m), r.sum())
    ridge = np.append(np.full(m, RIDGE), 1e-6)
    w = np.append(np.zeros(m), np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        grad = back(y - p) - ridge * w
        v = np.maximum(p * (1 - p), 1e-9)
        step, r = np.zeros(m + 1), grad.copy()
        d, rr = r.copy(), r @ r
        for _ in range(60):
            if rr < 1e-12:
                break
            hd = back(v * times(d)) + ridge * d
            a = rr / (d @ hd)
            step += a * d
            r -= a * hd
            rr, old = r @ r, rr
            d = r + d * (rr / old)
        w += step * min(1.0, 10 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, costs: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """(sorted feature keys, their weights, intercept) from at most FIT_ROWS labelled rows that are not held out, half of
    them of each label, those whose ids hash lowest; the intercept is set back to the share of labels in all of them."""
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~_held_out(F.col(id_col))).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("_toxic"))
    known = write_table(known, "toxic-labels")
    share = {r._toxic: r["count"] for r in known.groupBy("_toxic").count().collect()}
    none = (np.zeros(0, np.uint64), np.zeros(0), float(np.log((share.get(1, 0) + 0.5) / (share.get(0, 0) + 0.5))))
    if not share.get(1) or not share.get(0):
        return none
    picked = [known.where(F.col("_toxic") == y).orderBy(F.xxhash64(id_col), id_col).limit(FIT_ROWS // 2) for y in (0, 1)]
    chosen = picked[0].unionByName(picked[1])
    # FIT_ROWS ids at most go to every task, so that no text is shuffled for them
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(chosen), id_col)
    rows = write_table(deobfuscate(rows.select("_text", "_toxic", id_col), costs, text_col="_text"), "toxic-rows")
    given = rows.select("_text", "_toxic")

    def mine(toxic, doc, key):
        pair = np.unique(np.stack([doc.astype(np.uint64), key]), axis=1) if len(doc) else np.zeros((2, 0), np.uint64)
        key, count = np.unique(pair[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count)], names=["key", "t"])

    found = _tally(given.where("_toxic = 1"), "key long, t long", mine).groupBy("key").agg(F.sum("t").alias("t")).where(F.col("t") >= SUPPORT).orderBy(F.desc("t"), "key").limit(CANDIDATES).toArrow()
    keys, t = found.column("key").to_numpy().view(np.uint64), found.column("t").to_numpy()
    if len(keys) == 0:
        return none
    order = np.argsort(keys)
    t = t[order]
    held = spark.sparkContext.broadcast(Picked(keys))

    def clean(toxic, doc, key):
        number, count = np.unique(held.value.find(doc, key)[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(count)], names=["i", "c"])

    found = _tally(given.where("_toxic = 0"), "i long, c long", clean).groupBy("i").agg(F.sum("c").alias("c")).toArrow()
    c = np.zeros(len(keys))
    c[found.column("i").to_numpy()] = found.column("c").to_numpy()
    n1, n0 = (rows.where(F.col("_toxic") == y).count() for y in (1, 0))
    lift = (t / n1) / ((c + 0.5) / (n0 + 1))
    good = np.flatnonzero(lift >= LIFT)
    good = np.sort(good[np.argsort(-(t * np.log(lift))[good], kind="stable")[:FEATURES]])
    keys = np.sort(keys)[good]
    held = spark.sparkContext.broadcast(Picked(keys))

    def has(toxic, doc, key):
        doc, number = held.value.find(doc, key)
        yield pa.RecordBatch.from_arrays([pa.array(np.split(number, np.searchsorted(doc, np.arange(1, len(toxic)))), pa.list_(pa.int64())), pa.array(toxic.astype(np.int64))], names=["f", "y"])

    found = _tally(given, "f array<long>, y long", has).toArrow().combine_chunks()
    y = found.column("y").to_numpy().astype(float)
    lists = found.column("f").combine_chunks() if found.num_rows else None
    if lists is None:
        return none
    doc = np.repeat(np.arange(len(y)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    w = _logistic(doc, lists.flatten().to_numpy(), y, len(keys))
    return keys, w[:-1], float(w[-1] + np.log(share[1] / share[0]) - np.log(max(y.sum(), 0.5) / max(len(y) - y.sum(), 0.5)))


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Whole texts are lower-cased and cut into units that may be obfuscated (signs for letters, repeated letters, letters set
    apart); each unit is replaced by the path through its lattice of readings that a channel and a character language model
    of all texts make likeliest. Words and beginnings of words of the restored text then go into a logistic regression
    fitted on labelled rows whose id is not held out (crc32 of the id as text, mod 4, is not 2). Nothing but the text enters
    a score. predicted is 1 from ``threshold`` on.

    A null or empty text scores as one without evidence. Null ids are not held out and have no label; of several labels of
    one id the highest counts; null labels are left out. Without labels of both kinds every score is the same. Repeated rows
    score alike; an empty table gives no rows. One text is handled whole in one task."""
    costs = language_model(docs, text_col)
    keys, weights, intercept = fit(docs, labels, costs, id_col=id_col, text_col=text_col, label_col=label_col)
    held = docs.sparkSession.sparkContext.broadcast((costs, keys, weights))
    given = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, keys, weights = held.value
        view, known, picked = memoryview(costs), {}, Picked(keys)
        for batch in batches:
            for lo, hi, data, offs in text_blocks(_lowered(batch.column(1)), BLOCK):
                doc, number = picked.find(*features(*restore(data, offs, view, known)))
                z = np.bincount(doc, weights[number], hi - lo) + intercept if len(doc) else np.full(hi - lo, intercept)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-z)))], names=[id_col, "score"])

    id_type = given.schema[id_col].dataType.simpleString()
    out = given.mapInArrow(run, f"`{id_col}` {id_type}, score double")
    return out.select(id_col, _held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op13_noisy_channel_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
