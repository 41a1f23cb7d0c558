"""Language identification by string kernels (Nyström landmarks, kernel ridge regression).

Kernel.  The blended-spectrum presence kernel of two texts is the number of different
character n-grams, n = 1..``max_n``, that both contain.  It is normalised by the geometric
mean of the two texts' own counts.  A text is first lower-cased and each run of
non-letters becomes one space.  Only n-grams of the landmark texts are features, since
every other n-gram adds nothing to the kernel with any landmark.

Model.  ``landmarks`` labelled texts span the Nyström space.  One-versus-rest ridge
regression on the Nyström features has targets +1 and -1.  Languages have equal total weight.

Fitting uses a bounded sample of the labelled rows that are not held out: about ``per_lang``
rows of each language, chosen by a hash of ``doc_id``, with texts of ``min_chars`` to
``max_chars`` characters.  A language with fewer of these is filled up with longer texts, the
shortest first and whole, to ``per_lang * max_chars`` characters in all, and then with shorter
ones; any learned language has a row at least, however long.  With many languages ``max_rows``
rows are shared out evenly, ``landmarks`` is the number in all, and the ``max_labels`` most
frequent labels are learned, so a dirty label column cannot grow the sample, which is all that
reaches the driver.  Scoring covers every whole text: a batch becomes a
presence matrix, which is multiplied with the landmark matrix and then with the coefficients.

Defined cases: null text, empty text or a text without letters gives ``und`` with score 0;
so does every text if no labelled row with a letter exists.  Ties between languages go to the
alphabetically first one.  Repeated rows get equal results.  All input columns are kept,
except that ``lang_pred`` and ``score`` are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlens.llm.arrow_map import append_columns

UNDETERMINED = "und"
#: Grounds of a prediction: n-grams shared with a landmark, none (the bias decides alone), no fitted language, no letter.
KERNEL, NO_KERNEL, NO_MODEL, NO_LETTER = "kernel", "no kernel", "no model", "no letter"
SPACE = 32
MIX = np.uint64(0x9E3779B97F4A7C15)
SLOT_BITS = 20
COLUMNS = 1 << 18  # n-grams of the landmark matrix that are unpacked at once
LETTER = r"[\p{L}\p{Cn}]"  # also what Java's Unicode version does not know; letters() decides
INSIDE, SHORT = 0, 1  # length classes of the sample, longer texts from 2 on
HASH_STEP = 2.0 ** -40
PART = 1 << 19  # characters of a very long text that are turned into n-grams at once


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    """Code point -> its lower-case code point if it is a letter, else a space."""
    table = np.full(0x110000, SPACE, dtype=np.uint32)
    for i in range(0x110000):
        ch = chr(i)
        if ch.isalpha():
            low = ch.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def letters(text: str) -> np.ndarray:
    """Lower-case code points, each run of non-letters one space; empty if there is no letter."""
    cp = _letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    if not len(cp) or not (cp != SPACE).any():
        return np.empty(0, dtype=np.uint64)
    space = cp == SPACE
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    return cp[keep].astype(np.uint64)


def gram_keys(cp: np.ndarray, max_n: int) -> np.ndarray:
    """64-bit keys of all n-grams, n = 1..max_n."""
    keys, out = np.zeros(len(cp), dtype=np.uint64), []
    for n in range(1, max_n + 1):
        if len(cp) < n:
            break
        keys = (keys[:len(cp) - n + 1] * np.uint64(0x200003)) + cp[n - 1:] + np.uint64(1)
        out.append(keys)
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def text_grams(text: str | None, max_n: int) -> np.ndarray:
    """Sorted different n-grams of a text, long ones taken in overlapping parts."""
    cp = letters(text or "")
    parts = [np.unique(gram_keys(cp[at:at + PART + max_n - 1], max_n)) for at in range(0, len(cp), PART)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, dtype=np.uint64)


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys * MIX) >> np.uint64(64 - SLOT_BITS)


@dataclass
class KernelModel:
    langs: list[str]
    max_n: int
    vocab: np.ndarray       # sorted keys of the landmarks' n-grams
    landmarks: np.ndarray   # packed presence bits, a row for each landmark
    coef: np.ndarray        # landmarks x languages
    bias: np.ndarray

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """A model unpacked for use inside one task."""

    def __init__(self, model: KernelModel):
        self.m = model
        size = len(model.vocab)
        self.key_at = np.zeros(1 << SLOT_BITS, dtype=np.uint64)
        self.col_at = np.full(1 << SLOT_BITS, -1, dtype=np.int32)
        slots = _slots(model.vocab)
        self.key_at[slots], self.col_at[slots] = model.vocab, np.arange(size)
        more = self.key_at[slots] != model.vocab  # those whose slot another n-gram has; they are searched for
        self.more, self.more_col = model.vocab[more], np.flatnonzero(more)
        self.crowded = np.zeros(1 << SLOT_BITS, dtype=bool)
        self.crowded[slots[more]] = True
        self.own = np.sqrt(np.maximum(np.bitwise_count(model.landmarks).sum(axis=1, dtype=np.int64), 1))[:, None]
        self.land_t = self._land(0) if size <= COLUMNS else None

    def _land(self, at: int) -> np.ndarray:
        """The normalised landmark matrix, transposed, for ``COLUMNS`` n-grams from ``at`` on."""
        count = min(COLUMNS, len(self.m.vocab) - at)
        bits = np.unpackbits(self.m.landmarks[:, at // 8:(at + COLUMNS) // 8], axis=1, count=count) if count else np.zeros((0, 0))
        return np.ascontiguousarray((bits / self.own).T.astype(np.float32))

    def presence(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.m.vocab)), dtype=bool)
        for i, text in enumerate(texts):
            if text:
                cp = letters(text)
                for at in range(0, len(cp), PART):  # parts overlap, so no n-gram is missed
                    keys = gram_keys(cp[at:at + PART + self.m.max_n - 1], self.m.max_n)
                    slots = _slots(keys)
                    hit = self.key_at[slots] == keys
                    out[i, self.col_at[slots[hit]]] = True
                    rest = keys[~hit & self.crowded[slots]]
                    if len(rest):
                        where = np.minimum(np.searchsorted(self.more, rest), len(self.more) - 1)
                        out[i, self.more_col[where[self.more[where] == rest]]] = True
        return out

    def kernel(self, texts: list[str | None]) -> np.ndarray:
        """Normalised kernel of each text with each landmark."""
        return self._normalised(self.presence(texts))

    def _normalised(self, p: np.ndarray) -> np.ndarray:
        own = np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1)).astype(np.float32)
        if self.land_t is not None:
            return (p.astype(np.float32) @ self.land_t) / own
        return sum(p[:, at:at + COLUMNS].astype(np.float32) @ self._land(at)
                   for at in range(0, p.shape[1], COLUMNS)) / own

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[str]]:
        """Language, score, (decision + 1) / 2 held to 0..1, and ground of each text."""
        lettered = np.array([bool(t) and len(letters(t)) > 0 for t in texts], dtype=bool)
        if not self.m.langs:
            return ([UNDETERMINED] * len(texts), np.zeros(len(texts)),
                    [NO_MODEL if ok else NO_LETTER for ok in lettered])
        p = self.presence(texts)
        decision = self._normalised(p) @ self.m.coef + self.m.bias
        best = decision.argmax(axis=1)
        score = np.clip((decision[np.arange(len(texts)), best] + 1) / 2, 0, 1)
        return ([self.m.langs[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)],
                np.where(lettered, score, 0.0),
                [(KERNEL if some else NO_KERNEL) if ok else NO_LETTER for ok, some in zip(lettered, p.any(axis=1))])


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(texts: list[str], labels: list[str], landmarks: int = 160, max_n: int = 3,
          ridge: float = 1e-2) -> KernelModel:
    """Fit on given texts (in a fixed order); the first ones of each language become landmarks."""
    langs = sorted(set(labels))
    if not langs:
        return KernelModel([], max_n, np.empty(0, np.uint64), np.empty((0, 0), np.uint8), np.empty((0, 0)), np.empty(0))
    each = max(1, landmarks // len(langs))
    chosen = [i for lang in langs for i in [j for j, x in enumerate(labels) if x == lang][:each]]
    if len(chosen) > landmarks:   # more languages than landmarks: the first ones of all
        chosen = sorted(chosen)[:landmarks]
    grams = [text_grams(texts[i], max_n) for i in chosen]
    vocab = np.unique(np.concatenate(grams))
    bits = np.array([np.isin(vocab, g, assume_unique=True) for g in grams])
    model = KernelModel(langs, max_n, vocab, np.packbits(bits, axis=1), np.zeros((len(chosen), len(langs))),
                        np.zeros(len(langs)))
    scorer = Scorer(model)
    inner = scorer.kernel([texts[i] for i in chosen]).astype(np.float64)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    good = values > values.max() * 1e-6
    to_phi = vectors[:, good] / np.sqrt(values[good])
    rows = [scorer.kernel(texts[a:a + 128]).astype(np.float64) @ to_phi for a in range(0, len(texts), 128)]
    phi = np.concatenate(rows)
    y = np.array([[1.0 if x == lang else -1.0 for lang in langs] for x in labels])
    share = {lang: labels.count(lang) for lang in langs}
    w = np.array([1.0 / (share[x] * len(langs)) for x in labels])
    mean_phi, mean_y = w @ phi, w @ y
    c = phi - mean_phi
    solved = np.linalg.solve((c * w[:, None]).T @ c + ridge / len(texts) * np.eye(c.shape[1]),
                             (c * w[:, None]).T @ (y - mean_y))
    model.coef, model.bias = to_phi @ solved, mean_y - mean_phi @ solved
    return model


def sample_cuts(sizes: dict[int, tuple[int, int, float]], rows: int, chars: int) -> dict[int, float]:
    """Below which hash the rows of each length class are taken, for one language.

    ``sizes`` has the rows, characters and smallest hash of each class.  The quota ``rows`` goes to
    the texts inside the range, then to longer ones within ``chars``, then to shorter ones.
    """
    cuts: dict[int, float] = {}
    for c in sorted(sizes, key=lambda c: (c == SHORT, c)):
        n, total, _ = sizes[c]
        cuts[c] = max(0.0, min(1.0, rows / n, chars / total if c > SHORT else 1.0))
        rows, chars = rows - cuts[c] * n, chars - cuts[c] * total
        if cuts[c] < 1 and c > SHORT:
            chars = 0  # no longer class
    sure = min(sizes)  # one row at least, also where the share of a class rounds to none
    cuts[sure] = max(cuts[sure], sizes[sure][2] + HASH_STEP)
    return {c: cut for c, cut in cuts.items() if cut > 0}


def fit(docs: DataFrame, per_lang: int = 512, landmarks: int = 160, max_n: int = 3,
        min_chars: int = 100, max_chars: int = 4000, text: str = "text", lang: str = "lang",
        key: str = "doc_id", max_labels: int = 1000, max_rows: int = 8192) -> KernelModel:
    """Learn from rows with a label that are not held out (see the module text for the sample).

    The ``max_labels`` most frequent labels are learned (ties: smallest), from about ``max_rows``
    rows in all, shared out evenly, and at least one a label."""
    size = F.length("t")
    longer = F.lit(2) + F.floor(2 * F.log2(size / max_chars)).cast("int")
    usable = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where(
        F.col("l").isNotNull() & ~held_out(F.col("k")) & F.col("k").isNotNull() & F.col("t").rlike(LETTER)) \
        .withColumn("class", F.when(size < min_chars, SHORT).when(size <= max_chars, INSIDE).otherwise(longer)) \
        .withColumn("u", F.pmod(F.xxhash64("k"), F.lit(1 << 40)) / F.lit(float(1 << 40)))
    classes = usable.groupBy("l", "class").agg(F.count("*").alias("n"), F.sum(size).alias("chars"), F.min("u").alias("first"))
    frequent = classes.groupBy("l").agg(F.sum("n").alias("n"), F.collect_list(F.struct("class", "n", "chars", "first")).alias("of")) \
        .orderBy(F.desc("n"), "l").limit(max_labels).collect()   # a label's length classes are few: they grow with the logarithm
    rows_each = max(1, min(per_lang, max_rows // max(1, len(frequent))))
    cuts = [(r["l"], c, cut) for r in frequent for c, cut in
            sample_cuts({s["class"]: (s["n"], s["chars"], s["first"]) for s in r["of"]}, rows_each, rows_each * max_chars).items()]
    if not cuts:
        return train([], [], landmarks, max_n)
    chosen = F.broadcast(docs.sparkSession.createDataFrame(cuts, "l string, class int, cut double"))
    rows = usable.join(chosen, ["l", "class"]).where("u < cut").select("l", "t", "u", "k").collect()
    rows = sorted((r for r in rows if len(letters(r["t"]))), key=lambda r: (r["u"], r["k"], r["t"]))
    return train([r["t"] for r in rows], [r["l"] for r in rows], landmarks, max_n)


def annotate(docs: DataFrame, model: KernelModel, text: str = "text", keep: list[str] | None = None,
             ground: str | None = None) -> DataFrame:
    """All rows of ``docs`` with ``lang_pred`` and ``score``, and their ground in the column ``ground`` if named."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the landmarks' different n-grams
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if ground:
        fields.append(T.StructField(ground, T.StringType()))

    def make():
        scorer = held.value.scorer()

        def each(part: pa.RecordBatch) -> list[pa.Array]:
            pred, score, why = scorer.predict(part.column(text).to_pylist())
            new = [pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            return new + ([pa.array(why, pa.string())] if ground else [])
        return each

    return append_columns(docs, fields, make, slice_rows=128, keep=keep)
