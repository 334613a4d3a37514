"""Language identification: family first, then one-versus-one linear SVMs within the family.

A linear support vector machine for each pair of families votes for the family; then one for each
pair of its languages votes for the language. All are trained in numpy (Pegasos steps on averaged
weights) on a bounded sample, on standardised shares of hashed words and character n-grams of whole
texts; the standardisation is folded into the weights, so scoring is one table gather per machine.

``families`` maps language codes to families; a code that it lacks is a family of its own.

Defined results: text that is null or has no letter is ``und`` with score 0. If only one language is
learned, every other text gets it with score 1; without any, every text is ``und``. Ties go to the
alphabetically first. Repeated rows are each judged; extra columns are never inputs. A letter is a character
of Unicode's category L, in learning and in judging. An empty table gives no rows. Texts of any length are read
whole, window by window.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, held_out, map_batches, utf8, with_columns
from .hashing import mean_scores
from .samples import balanced, collect_features

BITS, PER_LANGUAGE, SAMPLE_ROWS, STEPS, UNKNOWN = 13, 400, 4000, 3000, "und"
LETTER = regex.compile(r"\p{L}")
#: Families of some languages with much text (ISO 639-1).
FAMILIES = {
    **dict.fromkeys(("en", "de", "nl", "sv", "da", "no", "is", "af"), "germanic"),
    **dict.fromkeys(("fr", "es", "pt", "it", "ro", "ca", "gl"), "romance"),
    **dict.fromkeys(("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"), "slavic"),
    **dict.fromkeys(("fi", "et", "hu"), "uralic"),
    **dict.fromkeys(("tr", "az", "kk", "uz"), "turkic"),
    **dict.fromkeys(("hi", "bn", "ur", "mr", "gu", "pa", "ne"), "indic"),
}


@dataclass
class LanguageModel:
    languages: dict[str, list[str]]  # by family
    pairs: list[tuple[str, str]]  # families, then languages: the machine's + and - side
    table: np.ndarray
    bias: np.ndarray

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        margin, _ = mean_scores(texts, self.table) if self.pairs else (np.zeros((len(texts), 0)), None)
        chance = {p: 1 / (1 + np.exp(-np.clip(2 * (margin[:, k] + self.bias[k]), -40, 40))) for k, p in enumerate(self.pairs)}
        families = sorted(self.languages)
        family, sure = self._vote(families, chance, len(texts))
        out, score = np.empty(len(texts), object), sure
        for f, name in enumerate(families):
            own = sorted(self.languages[name])
            best, inner = self._vote(own, chance, len(texts))
            mask = family == f
            out[mask] = np.array(own, object)[best[mask]]
            score[mask] *= inner[mask]
        return out.tolist(), score

    def _vote(self, names: list[str], chance: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The name with most votes (then the highest summed chance), and its least chance against another."""
        votes, least = np.zeros((n, len(names))), np.ones((n, len(names)))
        for (i, a), (j, b) in combinations(enumerate(names), 2):
            p = chance[a, b]
            votes[:, i] += (p >= 0.5) + 1e-3 * p
            votes[:, j] += (p < 0.5) + 1e-3 * (1 - p)
            least[:, i], least[:, j] = np.minimum(least[:, i], p), np.minimum(least[:, j], 1 - p)
        best = votes.argmax(1)
        return best, least[np.arange(n), best]


def svm(x: np.ndarray, y: np.ndarray, steps: int = STEPS, penalty: float = 1e-3, seed: int = 11) -> tuple[np.ndarray, float]:
    """Pegasos: hinge loss with L2 penalty, mean of the later weights. Each side has the same weight."""
    rng = np.random.default_rng(seed)
    w, b, mean_w, mean_b = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    sides = [np.flatnonzero(y > 0), np.flatnonzero(y < 0)]
    for t in range(1, steps // 16 + 1):
        some = np.concatenate([rng.choice(s, 8) for s in sides])
        rate = min(0.05, 1 / (penalty * (t + 200)))
        bad = some[y[some] * (x[some] @ w + b) < 1]
        w *= 1 - rate * penalty
        if len(bad):
            w += rate / 16 * (y[bad] @ x[bad])
            b += rate / 16 * y[bad].sum()
        if 2 * t > steps // 16:
            mean_w += w
            mean_b += b
    k = steps // 16 - steps // 32
    return mean_w / k, mean_b / k


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], families: dict[str, str] | None = None, bits: int = BITS) -> LanguageModel:
    of = FAMILIES if families is None else families
    languages: dict[str, list[str]] = {}
    for lang in sorted({y for y, _, _ in rows}):
        languages.setdefault("=" + of.get(lang, lang), []).append(lang)
    if len(rows) == 0 or sum(map(len, languages.values())) < 2:
        return LanguageModel(languages, [], np.zeros((1 << bits, 0)), np.zeros(0))
    x = np.zeros((len(rows), 1 << bits), np.float32)
    for i, (_, b, v) in enumerate(rows):
        x[i, b] = v
    mean, sd = x.mean(0), np.maximum(x.std(0), 2e-4)
    x = (x - mean) / sd
    x /= np.float32(np.sqrt(x.shape[1]))
    factor = 1 / (sd * np.sqrt(x.shape[1]))
    lang = np.array([y for y, _, _ in rows])
    family = np.array(["=" + of.get(y, y) for y in lang])
    pairs, table, bias = [], [], []
    for names, label in [(sorted(languages), family), *[(sorted(v), lang) for v in languages.values()]]:
        for a, b in combinations(names, 2):
            mask = (label == a) | (label == b)
            side = np.where(label[mask] == a, 1.0, -1.0)
            w, c = svm(x[mask], side)
            usual = max(1e-9, float(np.median(np.abs(x[mask] @ w + c))))  # a usual margin becomes 2
            w, c = w * (2 / usual), c * (2 / usual)
            pairs.append((a, b))
            table.append(w * factor)
            bias.append(c - (w * factor) @ mean)
    return LanguageModel(languages, pairs, np.stack(table, 1), np.array(bias))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, remainder: int = 2, families: dict[str, str] | None = None, bits: int = BITS, per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Train on documents with a language that aren't held out, about ``per_language`` of each and ``sample_rows`` in all."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).alias("y")).where(F.col("y").isNotNull() & F.col("t").rlike(r"\p{L}") & ~held_out(F.col("id"), modulus, remainder))
    some, _ = balanced(rows, "y", "id", per_language)
    return train(collect_features(some, "y", "t", "id", bits, sample_rows), families, bits)


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column(batch.schema.get_field_index(text_col))
            lang, score = shared.value.predict(utf8(column))
            none = [t is None or LETTER.search(t) is None for t in column.to_pylist()]
            lang = [UNKNOWN if x else y for x, y in zip(none, lang, strict=True)]
            return with_columns(batch, list(names), [pa.array(lang, pa.string()), pa.array(np.where(none, 0.0, score))])

        return step

    return map_batches(docs, make, schema)


def language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **kw) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    model = fit(docs, id_col, text_col, lang_col, **kw)
    named = with_language(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return named.select("doc_id", held_out(F.col("doc_id"), kw.get("modulus", 4), kw.get("remainder", 2)).alias("held_out"), "lang_pred", "score")


def keep_languages(docs: DataFrame, languages: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **kw) -> DataFrame:
    """``docs`` whose language is told (as one of ``languages``, if given); columns unchanged.

    Only text without letters is told as none; text in a language not learned passes as one that was.
    """
    model = fit(docs, id_col, text_col, lang_col, **kw)
    names = (fresh(docs.columns, "lang_pred"), fresh(docs.columns, "lang_score"))
    named = with_language(docs, model, text_col, names)
    good = F.col(names[0]) != UNKNOWN
    if languages is not None:
        good &= F.col(names[0]).isin(languages)
    return named.where(good).select(*[F.col(f"`{c}`") for c in docs.columns])
