"""Languages of a text as a mixture: expectation-maximisation over n-gram likelihoods, the set chosen by a penalty.

Each language is a distribution over hashed byte trigrams of lower-cased letters, counted over all training texts. A
text's trigrams are a mixture of languages and of a flat background; EM estimates the shares. Languages enter the set
one by one, in the order of their shares, as long as the likelihood gains more than a language costs.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Hash buckets of trigrams: the size of a language's distribution.
BUCKETS = 1 << 16
#: The model goes to every worker; more languages are refused. It bounds the model to 64 MB.
MAX_LANGUAGES = 256
SMOOTHING = 0.5
ROUNDS = 12
#: Log-likelihood that a further language must bring, times the logarithm of the text's trigrams: neighbouring trigrams
#: share letters, so it is three times the usual half.
PENALTY = 1.5
UNDETERMINED = "und"
#: Rows of a batch that are predicted before they are handed on. It bounds memory and changes no result.
ROWS_AT_ONCE = 512

_LETTER = re.compile(r"[^\W\d_]")
_TO_SPACE = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of the trigrams of a text's letters and word edges; empty if it has no letter."""
    if not text or not _LETTER.search(text):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    data = b" ".join([b"", *text.lower().encode().translate(_TO_SPACE).split(), b""])
    a = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    codes = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
    return np.unique((codes * np.uint32(0x9E3779B1)) >> np.uint32(16), return_counts=True)


def held_out(doc_id: Column) -> Column:
    """Documents that are never trained on: a quarter, by the id's checksum. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def counted(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n): trigram counts of all texts with a language, added up per task before the shuffle."""
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                buckets, n = trigrams(text)
                if lang not in sums:
                    if len(sums) >= MAX_LANGUAGES:
                        raise ValueError(f"more than {MAX_LANGUAGES} languages")
                    sums[lang] = np.zeros(BUCKETS, dtype=np.int64)
                sums[lang][buckets] += n
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])

    return docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(run, "lang string, bucket long, n long").groupBy(
        "lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Trigram distributions of languages, in the order of their names; the last column is the flat background."""

    def __init__(self, languages: Sequence[str], counts: np.ndarray):
        self.languages = list(languages)
        smooth = counts + SMOOTHING
        self.chances = np.concatenate([smooth / smooth.sum(axis=1, keepdims=True), np.full((1, BUCKETS), 1 / BUCKETS)]).T.astype(np.float32)

    def shares(self, chances: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
        """EM: (share of each column, log-likelihood)."""
        shares = np.full(chances.shape[1], 1 / chances.shape[1])
        for _ in range(rounds if chances.shape[1] > 1 else 0):
            parts = chances * shares
            new = (n / parts.sum(axis=1)) @ parts / n.sum()
            done = np.abs(new - shares).max() < 1e-3
            shares = new
            if done:
                break
        return shares, float(n @ np.log(chances @ shares))

    def predict(self, text: str | None) -> tuple[str, float, list[str], bool]:
        """(language, its share, set of languages, whether the background explains more than any language)."""
        buckets, n = trigrams(text)
        if not len(buckets) or not self.languages:
            return UNDETERMINED, 0.0, [], True
        chances, n = self.chances[buckets].astype(np.float64), n.astype(np.float64)
        shares, _ = self.shares(chances, n)
        order = np.argsort(-shares[:-1], kind="stable")
        kept, best = 1, -np.inf
        for k in range(1, len(order) + 1):
            fit = self.shares(chances[:, order[:k]], n)[1] - PENALTY * (k - 1) * np.log(n.sum())
            if fit <= best:
                break
            kept, best = k, fit
        chosen = order[:kept]
        final, _ = self.shares(chances[:, [*chosen, len(order)]], n)
        first = int(np.argmax(final[:-1]))
        return self.languages[chosen[first]], float(min(1.0, final[first])), [self.languages[i] for i in chosen], bool(final[-1] > final[first])


def fitted(docs: DataFrame) -> Model:
    """Model of all texts with a language that are not held out. A language's row is ``BUCKETS`` counts at most."""
    n = counted(docs.where(~held_out(F.col("doc_id"))))
    table = n.toArrow()  # at most MAX_LANGUAGES * BUCKETS rows; refused in the tasks if there are more languages
    names = sorted(set(table.column("lang").to_pylist()))
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts = np.zeros((len(names), BUCKETS))
    of = {name: i for i, name in enumerate(names)}
    counts[[of[x] for x in table.column("lang").to_pylist()], table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return Model(names, counts)


RESULTS = ("doc_id", "held_out", "lang_pred", "score", "languages", "rejected")


def identified(docs: DataFrame, train: DataFrame | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, languages, rejected, and the columns named in ``keep``.

    Trained on the rows of ``train`` (``docs`` itself if none) with a text and a lang that are not held out. A text that is
    null or has no letter is ``und`` with score 0 and no languages; it is rejected, as is a text that the background
    explains better than any language. Without any training row all texts are ``und``. Ties go to the language first in
    the alphabet. Texts of any length are used whole; lang, source and doc_id never are. Repeated rows give repeated results.
    Columns of ``keep`` that are named like a result give way to it; others may have any name.
    """
    keep = [c for c in keep if c.lower() not in RESULTS]
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs if train is None else train))
    kinds = dict(docs.dtypes)
    names = ["doc_id", "held_out", *keep]
    schema = ", ".join(f"`{c}` {'boolean' if c == 'held_out' else kinds[c]}" for c in names) + ", lang_pred string, score double, languages array<string>, rejected boolean"

    def run(batches):
        for batch in batches:
            for part in (batch.slice(low, ROWS_AT_ONCE) for low in range(0, batch.num_rows, ROWS_AT_ONCE)):
                found = [model.value.predict(text) for text in part.column(0).to_pylist()]
                made = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.list_(pa.string()), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*[part.column(sent.index(c)) for c in names], *made], names=[*names, "lang_pred", "score", "languages", "rejected"])

    # The tasks read their columns by place, so these get names of no meaning. A text that is kept is sent once.
    sent = ["text", *[c for c in names if c != "text"]]
    read = docs.select("text", "doc_id", held_out(F.col("doc_id")), *[F.col(f"`{c}`") for c in sent[3:]])
    return read.toDF(*[f"_column_{i}" for i in range(len(sent))]).mapInArrow(run, schema)
