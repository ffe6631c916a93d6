"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import col, crc_mod, map_rows, text_chunks

#: Characters of the longest gram.
ORDER = 4
#: Training texts of each language, in characters; distinct texts in the order of a hash, of these one in CALIBRATE to set the rejection.
#: This is the documented bound on the sample of labelled rows that the models are fitted on. A text gives one part in CALIBRATE of it at most.
TRAIN_CHARS = 1_500_000
CALIBRATE = 4
#: Languages that are learned at most, those of the most characters: each is a column of the model.
MOST_LANGS = 256
#: Bins of the hash that orders texts, for each halving of it.
BINS = 64
#: A text is rejected where its cross-entropy is more than this many deviations above its language's usual one.
DEVIATIONS = 8.0
#: No language takes a smaller deviation than this, in nats: mixed texts and ones with codes or numbers stay.
LEAST_DEVIATION = 0.25
DISCOUNT = 0.75
_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Every code point's lower-case letter, or a space for what isn't a letter; 0 stays, as the edge of a text."""
    table = np.full(0x110000, 32, np.int64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low[0])
    table[0] = 0
    return table


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, runs of other characters as one space, each text after ORDER - 1 edges; and each text's number of letters.

    A character 0 inside a text counts as a space.
    """
    edge = "\0" * (ORDER - 1)
    joined = edge + edge.join(t.replace("\0", " ") if "\0" in t else t for t in texts)
    c = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = c == 32
    keep = np.ones(len(c), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    size = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(size + ORDER - 1) - size  # each text's first character
    letters = np.concatenate([[0], np.cumsum(c > 32)])
    return c[keep], letters[starts + size] - letters[starts]


def grams(c: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each place; the first places wrap and stand for edges only."""
    key = np.zeros(len(c), np.uint64)
    for back in range(n - 1, -1, -1):
        key = (key + np.roll(c, back).astype(np.uint64) + np.uint64(1)) * _STEP
        key ^= key >> np.uint64(31)
    return key


class Model:
    """All languages' models: for each order the sorted hashes of its grams, with a log-probability by language, and of its contexts, with a back-off weight."""

    def __init__(self, langs: list[str]) -> None:
        self.langs = langs
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []  # by order, from 1
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []  # by order; a context's grams have this order
        self.floor = np.zeros(len(langs))
        self.limits: list[tuple[float, float, float]] = []

    def log_probs(self, c: np.ndarray) -> np.ndarray:
        """Natural log-probability of each place's character by each language, given up to ORDER - 1 characters before it."""
        out = np.zeros((len(c), len(self.langs)), np.float32)
        todo = np.arange(len(c))
        for n in range(ORDER, 0, -1):
            keys, values = self.grams[n - 1]
            k = grams(c, n)[todo]
            at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            hit = keys[at] == k
            out[todo[hit]] += values[at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
            if n > 1:
                keys, values = self.contexts[n - 1]
                k = np.roll(grams(c, n - 1), 1)[todo]
                at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                hit = keys[at] == k
                out[todo[hit]] += values[at[hit]]
        out[todo] += self.floor.astype(np.float32)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy by language in nats a character, scored characters and letters of each text."""
        c, letters = codes(texts)
        lp = self.log_probs(c)
        text_of = np.cumsum(c == 0) // (ORDER - 1) - 1  # each text, empty ones too, has its edges before it
        scored = c != 0
        sums = np.stack([np.bincount(text_of[scored], lp[scored, i], len(texts)) for i in range(len(self.langs))], 1)
        n = np.bincount(text_of[scored], minlength=len(texts))
        return -sums / np.maximum(n, 1)[:, None], n, letters


def _counts(texts: list[str]) -> dict:
    """Grams of each order with their characters and counts."""
    c, _ = codes(texts)
    scored = c != 0
    out = {}
    for n in range(1, ORDER + 1):
        key = grams(c, n)
        keys, first, count = np.unique(key[scored], return_index=True, return_counts=True)
        where = np.flatnonzero(scored)[first]
        chars = np.stack([np.where(where - b >= 0, c[where - b], 0) for b in range(n - 1, -1, -1)], 1)
        out[n] = keys, chars, count
    return out


def _hash_of(chars: np.ndarray) -> np.ndarray:
    """The hash that ``grams`` gives to rows of characters."""
    key = np.zeros(len(chars), np.uint64)
    for i in range(chars.shape[1]):
        key = (key + chars[:, i].astype(np.uint64) + np.uint64(1)) * _STEP
        key ^= key >> np.uint64(31)
    return key


class _Language:
    """Interpolated Kneser-Ney estimates of one language."""

    def __init__(self, texts: list[str], discount: float = DISCOUNT) -> None:
        raw = _counts(texts)
        self.d = discount
        self.tables, self.weights = {}, {}
        self.letters = max(1, len(raw[1][0])) + 1
        for n in range(1, ORDER + 1):
            keys, chars, count = raw[n]
            if n < ORDER:
                # Lower orders count in how many different characters' company a gram occurs.
                tails = _hash_of(raw[n + 1][1][:, 1:])
                order, number = np.unique(tails, return_counts=True)
                at = np.minimum(np.searchsorted(order, keys), max(0, len(order) - 1))
                count = np.where(order[at] == keys, number[at], 1) if len(order) else count
            contexts = _hash_of(chars[:, :-1]) if n > 1 else np.zeros(len(keys), np.uint64)
            ctx, inverse = np.unique(contexts, return_inverse=True)
            total = np.bincount(inverse, count, len(ctx))
            kinds = np.bincount(inverse, minlength=len(ctx))
            self.tables[n] = keys, np.maximum(count - discount, 0) / total[inverse] if len(keys) else np.zeros(0)
            self.weights[n] = ctx, discount * kinds / np.maximum(total, 1)

    @staticmethod
    def _get(table, keys, default):
        known, values = table
        if not len(known):
            return np.full(len(keys), default)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, values[at], default)

    def prob(self, chars: np.ndarray) -> np.ndarray:
        """P(last character | those before) of rows of characters."""
        n = chars.shape[1]
        if n == 0:
            return np.full(len(chars), 1.0 / self.letters)
        context = _hash_of(chars[:, :-1]) if n > 1 else np.zeros(len(chars), np.uint64)
        known = self._get(self.tables[n], _hash_of(chars), 0.0)
        return known + self._get(self.weights[n], context, 1.0) * self.prob(chars[:, 1:])


def fit(samples: dict[str, list[str]], held: dict[str, list[str]]) -> Model:
    """The model of all languages from training texts, with each one's usual cross-entropy from held-out texts."""
    langs = sorted(samples)
    model, each = Model(langs), [_Language(samples[k]) for k in langs]
    raw = [_counts(samples[k]) for k in langs]
    for n in range(1, ORDER + 1):
        keys, first = np.unique(np.concatenate([r[n][0] for r in raw]), return_index=True)
        chars = np.concatenate([r[n][1] for r in raw])[first]
        model.grams.append((keys, np.log(np.stack([m.prob(chars) for m in each], 1)).astype(np.float32)))
        ctx = np.unique(np.concatenate([m.weights[n][0] for m in each]))
        model.contexts.append((ctx, np.log(np.stack([m._get(m.weights[n], ctx, 1.0) for m in each], 1)).astype(np.float32)))
    # A letter that no language has: what the lowest order leaves over.
    model.floor = np.log([m._get(m.weights[1], np.zeros(1, np.uint64), 1.0)[0] / m.letters for m in each])
    for i, k in enumerate(langs):
        h, n, _ = model.entropies(held.get(k) or samples[k])
        h, n = h[n > 0, i], n[n > 0]
        mean = float(np.average(h, weights=n)) if len(h) else 3.0
        # Deviations have a part that stays and one that shrinks with the length.
        by_char = float(np.median((h - mean) ** 2 * n)) if len(h) > 1 else 1.0
        stays = max(LEAST_DEVIATION**2, float(np.median((h - mean) ** 2)) if len(h) > 1 else 0.0)
        model.limits.append((mean, stays, by_char))
    return model


def train(docs: DataFrame, usable: Column | None = None, text: str = "text", lang: str = "lang", chars: int = TRAIN_CHARS, most_langs: int = MOST_LANGS) -> Model | None:
    """Fits on a bounded sample: for each non-null language, distinct texts in the order of a hash of the text until ``chars`` are reached.

    None if no row has a language and a text. Only ``usable`` rows count. A text counts once, however many copies it has, with
    its first ``chars // CALIBRATE`` characters. Characters of texts, told apart by 64 bits of hash, are summed by language and bin
    of the hash, bins being BINS to each halving of it: map-side combines to at most 30 * BINS + 1 rows a language, however
    many texts there are. The lowest bins that reach the bound, give or take one bin, are the sample. A language of CALIBRATE texts
    or more always has some held out. Of more than MOST_LANGS languages those of the most characters are learned. So the driver holds
    at most MOST_LANGS times ``chars``, and a bin, of text.
    """
    rows = docs.where(col(docs, lang).isNotNull() & (F.length(col(docs, text)) > 0))
    if usable is not None:
        rows = rows.where(usable)
    most = max(1, chars // CALIBRATE)
    mark = F.xxhash64(col(docs, text), F.lit("lang"))
    order = lambda m: F.greatest(F.lit(1), F.pmod(m, F.lit(1 << 30)))
    bin_of = lambda m: F.floor(F.log2(F.lit(float(1 << 30)) / order(m)) * BINS).cast("int")  # noqa: E731 - the larger, the lower the hash
    once = rows.groupBy(col(docs, lang).alias("lang"), mark.alias("mark")).agg(F.max(F.least(F.length(col(docs, text)), F.lit(most)).cast("long")).alias("n"))
    bins = once.groupBy("lang", bin_of(F.col("mark")).alias("depth")).agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = bins.withColumn("before", before).groupBy("lang").agg(F.min(F.when(F.col("before") < chars, F.col("depth"))).alias("last"), F.sum("n").alias("all"))
    ends = ends.orderBy(F.desc("all"), "lang").limit(most_langs).select(F.col("lang").alias("known_lang"), "last")
    sample = rows.select(col(docs, lang).alias("lang"), F.substring(col(docs, text), 1, most).alias("text"), order(mark).alias("draw"), bin_of(mark).alias("depth"))
    sample = sample.join(F.broadcast(ends), F.col("lang") == F.col("known_lang")).where(F.col("depth") >= F.col("last")).select("lang", "text", "draw").distinct()
    used: dict[str, list[str]] = {}
    held: dict[str, list[str]] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["draw"], r["text"])):
        (held if r["draw"] % CALIBRATE == 0 else used).setdefault(r["lang"], []).append(r["text"])
    langs = sorted({*used, *held})
    if not langs:
        return None
    for k, texts in used.items():
        if k not in held and len(texts) >= CALIBRATE:
            held[k] = texts[1::CALIBRATE]
            used[k] = [t for i, t in enumerate(texts) if i % CALIBRATE != 1]
    return fit({k: used.get(k) or held[k] for k in langs}, held)


def identify(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, entropy, rejected of every whole text, one row for each row of ``docs``.

    ``lang_pred`` is the language of the lowest cross-entropy for a character (``und`` if the text is null or has no
    letter, or nothing was learned); ties go to the first language. ``score``, from 0 to 1, is its share among the
    languages, each weighed by exp(-entropy * min(characters, 40)); 0 for ``und``. ``rejected`` texts are null, have
    no letter, or are further above the language's usual cross-entropy than its held-out texts allow; without a model only the first two. Document ids may be null or repeat; an
    empty table gives no rows; other columns aren't read.
    """
    slim = docs.select(col(docs, doc_id).alias("doc_id"), col(docs, text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    schema = T.StructType([T.StructField("doc_id", slim.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches):
        for part, texts in text_chunks(batches, limit=1 << 20):
            lang, score, entropy, rejected = judge(shared.value, texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)], schema.names)

    return slim.mapInArrow(run, schema)


def judge(model: Model | None, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    if model is None:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), codes(texts)[1] == 0
    h, n, letters = model.entropies(texts)
    best = h.argmin(1)
    low = h[np.arange(len(h)), best]
    weight = np.exp(-(h - low[:, None]) * np.minimum(n, 40)[:, None])
    none = letters == 0
    mean, stays, by_char = np.array(model.limits).T[:, best]
    above = low > mean + DEVIATIONS * np.sqrt(stays + by_char / np.maximum(n, 1))
    return ["und" if e else model.langs[b] for e, b in zip(none, best, strict=True)], np.where(none, 0.0, 1.0 / weight.sum(1)), np.where(none, 0.0, low), none | above


def accepted(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that identification does not reject, learned from ``docs`` itself; columns as they were."""
    model = train(docs, None, text, lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches, name, _):
        for part, texts in text_chunks(batches, name, 1 << 20):
            yield part.filter(pa.array(~judge(shared.value, texts)[3]))

    return map_rows(docs, run, text)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learn = crc_mod(F.col("doc_id"), 5) != 0
    found = identify(docs, train(docs, learn))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "entropy", "rejected")
