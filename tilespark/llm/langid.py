"""Language identification by string-kernel ridge regression.

The kernel of two texts is the blended spectrum of presence: how many hashed byte n-grams, for n from 1 to 4, both hold,
over the root of the product of how many each holds. Nyström landmarks, a seeded sample of training texts, stand for the
whole kernel; one-versus-rest kernel ridge regression on them gives each language's weights. A text's kernel with the
landmarks is the product of presence vectors, so scoring is one matrix product a batch: presence times (landmarks times
weights).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 14
GRAMS = (1, 2, 3, 4)
#: Bound of the training sample: so many labelled texts of each language, and so many in all, shared among the languages.
TRAIN_PER_LANGUAGE = 400
TRAIN_ROWS = 80_000
LANDMARKS = 256
RIDGE = 1e-3
SHARPNESS = 8.0
UNKNOWN = "und"
MAYBE_LETTER = re.compile(r"[^\W\d_]")
SLICE_BYTES = 1 << 20


def has_letter(text: str) -> bool:
    """A letter is of a Unicode letter category; signs such as ½, ² or Ⅷ are none."""
    return any(m[0].isalpha() for m in MAYBE_LETTER.finditer(text))


def presence(texts: list[bytes], bits: int = BITS) -> np.ndarray:
    """A row per text of which hashed n-grams it holds. Zero bytes part the texts; n-grams start inside a text."""
    pad = max(GRAMS)
    out = np.zeros((len(texts), 1 << bits), bool)
    data = np.frombuffer((b"\0" * pad).join([*[t.replace(b"\0", b"\1") for t in texts], b""]) + b"\0", np.uint8)
    if not texts:
        return out
    sizes = np.array([len(t) for t in texts], np.int64)
    at = np.flatnonzero(data)
    row = np.repeat(np.arange(len(texts), dtype=np.int64) << bits, sizes)
    flat = out.reshape(-1)
    h = np.zeros(len(at), np.uint32)
    for n in GRAMS:
        h = (h + data[at + (n - 1)] + np.uint32(1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        flat[row + ((h + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits)).astype(np.int64)] = True
    return out


def normalised(seen: np.ndarray) -> np.ndarray:
    x = seen.astype(np.float32)
    return x / np.maximum(1.0, np.sqrt(x.sum(1, keepdims=True)))


def _slices(texts: list[str], most: int = SLICE_BYTES, rows: int = 64) -> Iterator[tuple[int, list[bytes]]]:
    """Lower-cased texts as bytes, in runs of about ``most`` bytes."""
    run: list[bytes] = []
    lo = size = 0
    for i, t in enumerate(texts):
        b = t.lower().encode("utf-8", "surrogatepass")
        if run and (size + len(b) > most or len(run) >= rows):
            yield lo, run
            run, lo, size = [], i, 0
        run.append(b)
        size += len(b)
    if run:
        yield lo, run


class KernelRidge:
    """One-versus-rest ridge regression on Nyström landmarks; ``weights`` has a column for each language."""

    def __init__(self, seen: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE, seed: int = 5):
        x = normalised(seen)
        self.languages = sorted(set(languages))
        y = np.array([[1.0 if a == b else -1.0 for b in self.languages] for a in languages])
        chosen = np.sort(np.random.default_rng(seed).permutation(len(x))[:landmarks])
        marks = x[chosen]
        k_nm = (x @ marks.T).astype(float)
        k_mm = (marks @ marks.T).astype(float)
        left = k_nm.T @ k_nm + ridge * len(x) * (k_mm + 1e-6 * np.eye(len(chosen)))
        self.weights = (marks.T.astype(float) @ np.linalg.lstsq(left, k_nm.T @ y, rcond=None)[0]).astype(np.float32)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return normalised(presence(texts)) @ self.weights


def held_out(id_col: str = "doc_id"):
    """Every fifth document by the CRC of its id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_PER_LANGUAGE) -> KernelRidge | None:
    """Fit on a seeded sample of at most ``per_language`` labelled texts of each language; none labelled: None.

    Every labelled language is learned. What reaches the driver is ``TRAIN_ROWS`` presence vectors of 2 KB at most, shared
    among the languages, and one of each at least.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.lit(11), F.col(id_col), F.col(text_col)).alias("draw"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    per_language = max(1, min(per_language, TRAIN_ROWS // len(sizes)))
    # Draw about twice as many (40 more at least, so that no language is missed) by hash where a language has more, then keep the first by hash: exact and without a full sort.
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, max(2.0 * per_language, per_language + 40.0) / n))])
    drawn = rows.where(F.pmod(F.col("draw"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * F.lit(float(1 << 30)))

    def packed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for lo, run in _slices(frame["text"].tolist()):
                seen = np.packbits(presence(run), axis=1)
                part = frame.iloc[lo : lo + len(run)]
                yield pd.DataFrame({"lang": part["lang"].values, "draw": part["draw"].values, "seen": [r.tobytes() for r in seen]})

    # Rows that repeat id, text and language are one, so that a group holds no more than was drawn.
    drawn = drawn.groupBy("lang", "draw").agg(F.first("text").alias("text"))
    vectors = drawn.mapInPandas(packed, "lang string, draw long, seen binary")
    found = vectors.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("draw", "seen"))), 1, per_language).alias("rows")).collect()
    languages = [r["lang"] for r in sorted(found, key=lambda r: r["lang"]) for _ in r["rows"]]
    bits = [np.frombuffer(v["seen"], np.uint8) for r in sorted(found, key=lambda r: r["lang"]) for v in r["rows"]]
    if not bits:
        return None
    return KernelRidge(np.unpackbits(np.stack(bits), axis=1).astype(bool), languages)


def predicted(texts: list[str | None], model: KernelRidge | None) -> tuple[list[str], list[float]]:
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model is None:
        return names, scores
    known = [i for i, t in enumerate(texts) if t is not None and has_letter(t)]
    for lo, run in _slices([texts[i] for i in known]):
        f = SHARPNESS * model.scores(run).astype(float)
        p = np.exp(f - f.max(1, keepdims=True))
        best = f.argmax(1)
        top = 1 / p.sum(1)
        for j, (b, s) in enumerate(zip(best.tolist(), top.tolist())):
            names[known[lo + j]], scores[known[lo + j]] = model.languages[b], round(s, 6)
    return names, scores


def identify(docs: DataFrame, model: KernelRidge | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: ``doc_id, held_out, lang_pred, score``. Only the text decides; no row limit, whole texts.

    Null, empty and letterless texts are ``und`` with score 0, and so is every text if there was nothing to learn from.
    Equal texts get equal answers; repeated rows stay; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def score(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            names, scores = predicted([t if isinstance(t, str) else None for t in frame["text"].tolist()], model)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "held_out": frame["held_out"], "lang_pred": names, "score": scores})

    return rows.mapInPandas(score, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_score: float = 0.3) -> DataFrame:
    """``docs`` without texts of no known language: those without letters and those whose best score is under ``least_score``.

    Null and empty texts have no letters and go; an empty table stays empty; repeated rows stay or go alike. Other columns are not looked at and stay. Without labelled texts nothing can be rejected but letterless ones.
    """
    model = train(docs, id_col, text_col, lang_col)

    @F.pandas_udf("boolean")
    def known(column: pd.Series) -> pd.Series:
        texts = [t if isinstance(t, str) else None for t in column.tolist()]
        if model is None:
            return pd.Series([t is not None and has_letter(t) for t in texts], dtype=bool)
        names, scores = predicted(texts, model)
        return pd.Series([n != UNKNOWN and s >= least_score for n, s in zip(names, scores)], dtype=bool)

    return docs.where(known(F.col(text_col).cast("string")))
