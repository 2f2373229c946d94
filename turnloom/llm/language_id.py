"""Language identification by error-correcting output codes.

Every language has a codeword of bits; a linear classifier over hashed character n-grams
predicts each bit, fitted by ridge regression. A text is decoded to the codeword of least loss,
where each bit's squared loss counts the more the smaller that classifier's mean loss is on rows it
was not fitted on: the sample is cut in PARTS, each judged by classifiers of the others, and the
final ones are fitted on all. score is the softmax of the negated losses; a text is ambiguous if
the best two losses are closer than MARGIN, or if its n-grams are strange to the language found: their mean
log probability there is more than STRANGE below that of all but one in a hundred of the sample's rows.

The classifiers are fitted on a bounded sample: of each language at most PER_LANGUAGE texts, those
of the smallest hash of doc_id, among rows with a text and a language and outside the held-out fold (of rows of one doc_id the
smallest text), and fewer of each where more than SAMPLE would come together. Languages are learned only up to
SAMPLE / 2, the most frequent ones. Only the n-gram counts of that sample reach the driver. Each
language's rows are counted first, and only hashes below a bound that lets about twice as many
through as are needed are ranked, so a language of most rows sends no more than others.

Defined results: a null text or one without a letter is und with score 0; a null doc_id is not
held out and never in the sample; repeated rows give one row each; with no labelled rows at all
every text is und; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnloom.llm import pretoken
from turnloom.llm.common import map_texts

PER_LANGUAGE = 400
SAMPLE = 4000
DIMS = 4096
FOLDS, HELD_OUT = 3, 1
RIDGE = 0.02
MARGIN = 0.1
STRANGE = 2.0
SHARPNESS = 4.0
PARTS = 4
#: Texts that are counted together.
TOGETHER = 128


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n codewords of -1 and 1, the best of some random draws by least distance of any two."""
    rng = np.random.default_rng(seed)
    bits = max(15, 6 * int(np.ceil(np.log2(max(2, n)))))
    best, most = None, -1
    for _ in range(200):
        m = rng.choice([-1, 1], (n, bits))
        useful = np.abs(m.sum(0)) < n if n > 1 else np.ones(bits, bool)
        apart = min((int((m[i] != m[j]).sum()) for i in range(n) for j in range(i)), default=bits) if n <= 30 else int(np.partition(((m[:, None] != m).sum(2) + bits * np.eye(n, dtype=int)).ravel(), 0)[0])
        if apart + int(useful.sum()) > most:
            best, most = m, apart + int(useful.sum())
    return best


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of hashed counts of letter pairs and triples (rooted, of length one), and whether a text has a letter."""
    x = np.zeros((len(texts), DIMS), np.float32)
    letters = np.zeros(len(texts), bool)
    cls = pretoken.classes()
    for a in range(0, len(texts), TOGETHER):
        some = [t.lower() for t in texts[a : a + TOGETHER]]
        flat, starts = pretoken.code_points(some)
        kind = cls[flat]
        letter = (kind == pretoken.L) | ((kind >= pretoken.C_STMD) & (kind <= pretoken.C_LL))
        row = np.cumsum(flat == 0x110000)
        row -= flat == 0x110000
        letters[a : a + len(some)] = np.bincount(row[letter], minlength=len(some))[: len(some)] > 0
        c = np.where(letter, flat, 32).astype(np.uint32)
        pair = c[:-1] * np.uint32(0x9E3779B1) ^ c[1:] * np.uint32(0x85EBCA6B)
        triple = pair[:-1] * np.uint32(0xC2B2AE35) ^ c[2:] * np.uint32(0x27D4EB2F)
        base = row * DIMS
        counts = np.zeros(len(some) * DIMS, np.int64)
        for h, width in ((pair, 2), (triple, 3)):
            some_letter = letter[: len(h)] | letter[1 : len(h) + 1]
            at = base[: len(h)] + (h >> np.uint32(20)).astype(np.int64)
            inside = (row[: len(h)] == row[width - 1 :]) & some_letter
            counts += np.bincount(at[inside], minlength=len(counts))
        root = np.sqrt(counts.reshape(len(some), DIMS).astype(np.float32))
        x[a : a + len(some)] = root / np.maximum(np.linalg.norm(root, axis=1, keepdims=True), 1e-9)
    return x, letters


class Model:
    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        self.names = sorted(set(langs))
        code = codewords(len(self.names)) if self.names else np.zeros((0, 1))
        self.code = code.astype(np.float32)
        if not self.names:
            return
        y = self.code[[self.names.index(v) for v in langs]]
        part = np.arange(len(x)) % PARTS
        loss = np.ones(y.shape[1])
        if len(x) >= 2 * PARTS:
            unseen = np.empty(y.shape)
            for k in range(PARTS):
                w, mean = self._fit(x[part != k], y[part != k])
                unseen[part == k] = np.clip(x[part == k] @ w + mean, -1, 1)
            loss = ((unseen - y) ** 2).mean(0)
        self.weight = 1 / (loss + 0.01)
        self.weight /= self.weight.sum()
        # shares of n-grams in each language; rows are rooted shares
        own = np.array([self.names.index(v) for v in langs])
        shares = np.array([(x[own == i] ** 2).mean(0) for i in range(len(self.names))]) + 0.1 / DIMS / 2
        self.familiar = np.log(shares / shares.sum(1, keepdims=True)).astype(np.float32)
        self.strange = float(np.quantile(((x**2) * self.familiar[own]).sum(1), 0.01)) - STRANGE
        self.w, self.mean = self._fit(x, y)

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ridge regression of the bits, in its dual form."""
        gram = x.astype(np.float64) @ x.T.astype(np.float64)
        mean = y.mean(0)
        alpha = np.linalg.solve(gram + RIDGE * len(x) ** 0.5 * np.eye(len(x)), y - mean)
        return (x.T @ alpha).astype(np.float32), mean

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        x, letters = ngrams(texts)
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        f = np.clip(x @ self.w + self.mean, -1, 1)
        loss = ((f[:, None, :] - self.code) ** 2 * self.weight).sum(2)
        p = np.exp(-SHARPNESS * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = loss.argmin(1)
        order = np.sort(loss, 1)
        unsure = (order[:, 1] - order[:, 0] < MARGIN) if len(self.names) > 1 else np.zeros(len(texts), bool)
        unsure |= ((x**2) * self.familiar[best]).sum(1) < self.strange
        names = [self.names[i] if ok else "und" for i, ok in zip(best, letters)]
        return names, np.where(letters, p[np.arange(len(texts)), best], 0.0).astype(float), unsure | ~letters


def fold(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % FOLDS


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """The model of df's sample; the n-gram counts of the sample are all that is collected."""
    rows = df.where(df[text].isNotNull()).select(df[key].cast("string").alias("k"), df[lang].alias("lang"))
    known = rows.where((fold(F.col("k")) != HELD_OUT) & F.col("lang").isNotNull())
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE // 2).collect()
    each = max(2, min(PER_LANGUAGE, SAMPLE // max(1, len(counts))))
    place = F.shiftrightunsigned(F.xxhash64("k"), 1)
    bounds = df.sparkSession.createDataFrame([(r["lang"], int(min(1.0, (2 * each + 20) / r["count"]) * ((1 << 63) - 1025))) for r in counts], "lang string, bound bigint")
    bounds = bounds.withColumn("lang", F.col("lang").cast(rows.schema["lang"].dataType))
    # SAMPLE / 2 rows are broadcast; those that pass are some SAMPLE * 2 rows
    passed = known.withColumn("place", place).join(F.broadcast(bounds), "lang").where("place <= bound").select("lang", "k", "place").distinct()
    order = Window.partitionBy("lang").orderBy("place", "k")
    ids = passed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= each).select("k", "lang")
    src = df.select(df[key].cast("string").alias("k"), df[lang].alias("lang"), df[text].alias("text"))
    # at most SAMPLE ids: a fixed bound
    sample = src.join(F.broadcast(ids), ["k", "lang"], "left_semi").groupBy("k", "lang").agg(F.min("text").alias("text"))

    def run(texts: list[str]) -> dict[str, pa.Array]:
        x, ok = ngrams(texts)
        return {"x": pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary()), "ok": pa.array(ok)}

    got = map_texts(sample, "text", ["k", "lang"], run, "x binary, ok boolean").where("ok").orderBy("k", "lang", "x").collect()
    x = np.array([np.frombuffer(r.x, np.float16) for r in got], np.float32).reshape(len(got), DIMS)
    return Model(x, [r.lang for r in got])


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every row's whole text."""
    model = df.sparkSession.sparkContext.broadcast(train(df, key, text, lang))  # DIMS x bits numbers
    src = df.select(df[key].alias("doc_id"), df[text].alias("text"))

    def run(texts: list[str]) -> dict[str, pa.Array]:
        names, score, unsure = model.value.predict(texts)
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(score, pa.float64()), "ambiguous": pa.array(unsure)}

    out = map_texts(src, "text", ["doc_id"], run, "lang_pred string, score double, ambiguous boolean")
    return out.withColumn("held_out", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
