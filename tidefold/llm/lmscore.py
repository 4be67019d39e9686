"""Language-model scoring by cross-entropy difference.

Two bigram models over the tokens of a public tokenizer, a target model and a background model, share
one vocabulary (all ids of the tokenizer) and one form. After the token v the probability of w is

    p(w | v) = (count(v w) + alpha * p(w)) / (count(v .) + alpha)
    p(w)     = (count(w) + alpha / vocabulary) / (tokens + alpha)

so after any context the probabilities sum to 1 and no loss is negative. A text begins with a start
symbol that is never predicted; every token is scored. The background counts all documents, the target
those of the target set. A document's score is its mean loss per token under the target model minus
that under the background model: the lower, the more it resembles the target.

Every bigram is counted exactly, in a table in the shared folder that grows with the corpus. Texts are
encoded once; the ids go to the shared folder in portions of about `portion_tokens` tokens. A portion
has far fewer distinct bigrams than tokens, so only those are shuffled: once to be added up over all
portions, once to be joined to the sums, and back to their portion, whose documents they score. Only
counts of single tokens, an array as long as the vocabulary, are held whole.

Defined results: null text counts as empty; a text without tokens has null scores; rows with a null or
repeated doc_id are counted and scored by themselves; without a target document the target model is the
uniform one. Extra columns are ignored; empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attribution import ByteEncoder
from .common import cut, map_batches, small_side
from .tokens import tokenizer_path

ALPHA = 4.0
#: Tokens of a portion, and tokens that are scored at once.
PORTION, BLOCK = 1 << 22, 1 << 20
#: A bigram is one number: its first token (or the start symbol) times 2**24, plus its second.
BITS = 24

TOKENS = "portion long, doc_id long, is_target boolean, n_tokens long, ids binary"
RESULT = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
_SCORED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *[(c, pa.float64()) for c in ("target_loss", "background_loss", "score")]])


@dataclass
class Model:
    """counts: the table of bigrams (gram, target, background). For target and background in turn,
    tokens and contexts: how often each id occurs, and how often it stands before a token (the start
    symbol comes last)."""

    counts: DataFrame
    tokens: np.ndarray
    contexts: np.ndarray
    alpha: float = ALPHA

    def probability(self, which: int, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """p of the second token of each bigram after the first, given the bigrams' own counts."""
        first, second = grams >> BITS, grams & ((1 << BITS) - 1)
        one, a = self.tokens[which], self.alpha
        p = (one[second] + a / len(one)) / (one.sum() + a)
        return (counts + a * p) / (self.contexts[which][first] + a)


def tokenise(
    documents: DataFrame, targets: DataFrame | None = None, tokenizer: str | None = None, portion_tokens: int = PORTION
) -> DataFrame:
    """TOKENS: the ids of every document (16 bits each, packed), by portions; targets: doc_id of the
    target set."""
    path = tokenizer or tokenizer_path("byte_bpe_50k.tiktoken")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if targets is None:
        docs = docs.withColumn("is_target", F.lit(False))
    else:
        ids = cut(targets.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("t")).distinct(), "lm-targets")
        docs = docs.join(small_side(ids), F.col("doc_id") == F.col("t"), "left").select("doc_id", "text", F.col("t").isNotNull().alias("is_target"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder.shared(path)
        portion, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            portions, sizes, packed = [], [], []
            for text in batch.column("text"):
                ids = encoder.ids(text.as_py() or "")
                portions.append(portion)
                sizes.append(len(ids))
                packed.append(pa.compress(ids.astype("<u2").tobytes(), "zstd", asbytes=True))
                held += len(ids)
                if held >= portion_tokens:
                    portion, held = portion + 1, 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(portions, pa.int64()), batch.column("doc_id"), batch.column("is_target"), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())],
                [x.split()[0] for x in TOKENS.split(", ")],
            )

    return cut(map_batches(docs, run, TOKENS), "lm-tokens")


def unpacked(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, 2 * n, "zstd") if n else b"", "<u2").astype(np.int64)


def bigrams(ids: np.ndarray, before: int) -> np.ndarray:
    """The bigram that ends with each token; `before` stands before the first."""
    out = ids.copy()
    out[1:] |= ids[:-1] << BITS
    if len(out):
        out[0] |= before << BITS
    return out


def portion_grams(tokens: DataFrame, vocabulary: int) -> DataFrame:
    """portion, gram, target, background: the distinct bigrams of each portion and how often it has
    them. A portion that is read in two parts may give a bigram twice."""

    def counted(portion: int, grams: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        marked, n = np.unique(np.concatenate(grams), return_counts=True)
        gram, target = marked >> 1, n * (marked & 1)
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
        columns = [gram[first], np.add.reduceat(target, first), np.add.reduceat(n, first)] if len(first) else [gram, target, n]
        for a in range(0, len(first), 1 << 17):
            part = [pa.array(c[a : a + (1 << 17)].astype(np.int64)) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), portion)), *part], ["portion", "gram", "target", "background"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, grams, held = None, [], 0
        for batch in batches:
            for portion, aim, n, ids in zip(*(batch.column(c).to_pylist() for c in ("portion", "is_target", "n_tokens", "ids")), strict=True):
                if grams and (portion != at or held >= PORTION):
                    yield from counted(at, grams)
                    grams, held = [], 0
                at, held = portion, held + n
                own = unpacked(ids, n)
                grams.append(bigrams(own, vocabulary) << 1 | int(aim))
        if grams:
            yield from counted(at, grams)

    schema = "portion long, gram long, target long, background long"
    return cut(map_batches(tokens.select("portion", "is_target", "n_tokens", "ids"), run, schema), "lm-portion-grams")


def fit(grams: DataFrame, vocabulary: int, alpha: float = ALPHA) -> Model:
    """Both models from the bigrams of all portions."""
    counts = cut(grams.groupBy("gram").agg(F.sum("target").alias("target"), F.sum("background").alias("background")), "lm-grams")

    def sums(key, size: int) -> np.ndarray:  # at most one row for each id
        rows = counts.groupBy(key.cast("long").alias("id")).agg(F.sum("target").alias("t"), F.sum("background").alias("b")).toArrow()
        out = np.zeros((2, size))
        for i, c in enumerate(("t", "b")):
            out[i, rows.column("id").to_numpy()] = rows.column(c).to_numpy()
        return out

    second = F.col("gram").bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))
    return Model(counts, sums(second, vocabulary), sums(F.shiftright("gram", BITS), vocabulary + 1), alpha)


def score(tokens: DataFrame, grams: DataFrame, model: Model, block: int = BLOCK) -> DataFrame:
    """Mean losses per token of both models and their difference for every document."""
    vocabulary = model.tokens.shape[1]
    shared = tokens.sparkSession.sparkContext.broadcast((model.tokens, model.contexts))
    alpha = model.alpha

    def one(docs: pa.Table, found: pa.Table) -> pa.Table:
        own = Model(None, *shared.value, alpha)
        known, first = np.unique(found.column("gram").to_numpy(), return_index=True)
        loss = [
            -np.log(own.probability(i, known, found.column(c).to_numpy()[first])) for i, c in enumerate(("target", "background"))
        ]
        sums = np.zeros((2, docs.num_rows))
        for d, (n, packed) in enumerate(zip(docs.column("n_tokens").to_pylist(), docs.column("ids"), strict=True)):
            ids = unpacked(packed.as_py(), n)
            for a in range(0, n, block):
                at = np.searchsorted(known, bigrams(ids[a : a + block], ids[a - 1] if a else vocabulary))
                sums[:, d] += [x[at].sum() for x in loss]
        n = docs.column("n_tokens").to_numpy()
        t, b = (pa.array(np.divide(x, n, out=np.zeros(len(n)), where=n > 0), mask=n == 0) for x in sums)
        both = pa.array((sums[0] - sums[1]) / np.maximum(n, 1), mask=n == 0)
        return pa.Table.from_arrays([docs.column("doc_id"), docs.column("n_tokens"), t, b, both], schema=_SCORED)

    known = grams.select("portion", "gram").join(model.counts, "gram")
    wanted = tokens.select("portion", "doc_id", "n_tokens", "ids")
    return wanted.groupBy("portion").cogroup(known.groupBy("portion")).applyInArrow(one, RESULT)


def score_documents(
    documents: DataFrame, targets: DataFrame, tokenizer: str | None = None, alpha: float = ALPHA, portion_tokens: int = PORTION
) -> DataFrame:
    """Both models fitted on the documents, and every document's score."""
    path = tokenizer or tokenizer_path("byte_bpe_50k.tiktoken")
    vocabulary = len(ByteEncoder.shared(path).length)
    if vocabulary > 1 << 16:
        raise ValueError("ids are packed in 16 bits: choose a tokenizer of at most 65,536 ids")
    tokens = tokenise(documents, targets, path, portion_tokens)
    grams = portion_grams(tokens, vocabulary)
    return score(tokens, grams, fit(grams, vocabulary, alpha))
