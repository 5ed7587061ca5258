"""Language identification by a linear-chain conditional random field over words.

Every word of a text gets a label, so text that changes language is labelled word by word.  A word's score for each
language comes from its letter n-grams, its affixes (n-grams that touch the word's ends) and a lexicon of frequent
words; learned transitions join neighbours.  Forward-backward gives each word's posterior, and a document has the
language with the largest sum of posteriors; its score is that sum's share.  Words are read from the whole text.

Training: at most ``SAMPLE`` documents (those with the smallest hash of their doc_id).  A softmax over words first learns
from the documents' languages; decoding with it relabels the words of passages in another language; then word scores
and transitions are trained together on those labels by the gradient of the chain's likelihood.

Distinct words of a batch are scored once, and forward-backward runs over all documents of a batch at a time, so a
long document costs steps but no more memory than its words.

Nulls: a null text, or one without a letter, is ``und`` with score 0, as is everything if nothing can be learned.  A
null doc_id is held out from training and has held_out false.  Ties go to the language that sorts first.  Repeated rows
are labelled alike.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import table
from quillmark.llm.tokens import slices

SAMPLE = 1200  # documents
#: Bytes of the texts that it is trained on: of each and of all together, at most.
LONGEST, SAMPLE_BYTES = 1 << 18, 1 << 25
LEXICON = 4000  # words
BUCKETS = 1 << 15
GRAMS = (1, 2, 3, 4)
TRAIN_WORDS = 128  # words of a training sequence
#: Bytes of text, and distinct words, scored at once; they bound a worker's memory.
SLICE_BYTES, WORDS = 3 << 20, 25_000


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words (letters only, lower case), the words of all texts as indices of them, words of each text."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    known: dict[str, int] = {}
    place = np.empty(len(coded.dictionary), np.int64)
    for i, raw in enumerate(coded.dictionary.to_pylist()):
        word = raw.lower()
        if not word.isalpha():
            word = "".join(filter(str.isalpha, word))
        place[i] = known.setdefault(word, len(known)) if word else -1
    index = place[coded.indices.to_numpy()]
    kept = index >= 0
    ends = np.concatenate([[0], np.cumsum(kept)])[offsets - offsets[0]]
    return list(known), index[kept], np.diff(ends)


class Features:
    """Hashed n-grams of words, as flat arrays: (bucket, word) pairs in order of the word."""

    def __init__(self, words: list[str]):
        flat = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        owner = np.cumsum(flat == 2) - 1
        self.n = len(words)
        buckets, owners = [], []
        for n in GRAMS:
            if len(flat) < n:
                continue
            h = np.full(len(flat) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ flat[k : len(flat) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            inside = owner[: len(h)] == owner[n - 1 :]
            buckets.append((h[inside] % np.uint64(BUCKETS)).astype(np.int32))
            owners.append(owner[: len(h)][inside])
        self.bucket = np.concatenate(buckets)
        self.owner = np.concatenate(owners)
        self.share = 1 / np.sqrt(np.bincount(self.owner, minlength=self.n))

    def score(self, weights: np.ndarray) -> np.ndarray:
        out = np.stack([np.bincount(self.owner, w[self.bucket], self.n) for w in weights.T], axis=1)
        return out * self.share[:, None]

    def pull(self, grad: np.ndarray) -> np.ndarray:
        own = grad * self.share[:, None]
        return np.stack([np.bincount(self.bucket, g[self.owner], BUCKETS) for g in own.T], axis=1)


def scores(words: list[str], model: dict) -> np.ndarray:
    """Log potentials of every word for every language."""
    if not words:
        return np.zeros((0, len(model["langs"])))
    out = np.concatenate([Features(words[lo : lo + WORDS]).score(model["grams"]) for lo in range(0, len(words), WORDS)])
    rows = np.fromiter((model["lexicon"].get(w, -1) for w in words), np.int64, len(words))
    out[rows >= 0] += model["known"][rows[rows >= 0]]
    return out


def chains(psi: np.ndarray, index: np.ndarray, counts: np.ndarray, step: np.ndarray, start: np.ndarray, words: bool = True):
    """Forward-backward over sequences at once.

    psi: potentials of distinct words; index: words of all sequences; counts: words of each.  Returns the posteriors
    (word by word, in the order of ``index``; without ``words``, their sums for each sequence), expected transitions,
    expected first labels and the log likelihood's normaliser.
    """
    k = psi.shape[1]
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # sequences longer than t
    base = np.concatenate([[0], np.cumsum(active)])
    rank = np.empty(len(counts), np.int32)
    rank[order] = np.arange(len(counts))
    t = np.arange(len(index), dtype=np.int32) - np.repeat((np.cumsum(counts) - counts).astype(np.int32), counts)
    place = base.astype(np.int32)[t] + np.repeat(rank, counts)  # of each word in order of time
    del t
    at = np.empty(len(index), np.int32)
    at[place] = index
    alpha, expected, norm = np.empty((len(index), k)), np.zeros((k, k)), 0.0
    last = None
    for i in range(longest):
        lo, hi = base[i], base[i + 1]
        a = psi[at[lo:hi]] * (start if last is None else last[: hi - lo] @ step)
        total = a.sum(axis=1, keepdims=True)
        a /= total
        if words:
            norm += float(np.log(total).sum())
        alpha[lo:hi] = last = a
    sums = np.zeros((len(counts), k))
    beta = np.ones((0, k))
    p = np.zeros((len(counts), k))
    for i in range(longest - 1, -1, -1):
        lo, hi = base[i], base[i + 1]
        full = np.ones((hi - lo, k))
        if len(beta):
            nxt = psi[at[base[i + 1] : base[i + 2]]] * beta
            back = nxt @ step.T
            if words:
                pair = alpha[lo : lo + len(nxt)]
                expected += (pair / (pair * back).sum(axis=1, keepdims=True)).T @ nxt
            full[: len(nxt)] = back / back.sum(axis=1, keepdims=True)
        beta = full
        p = alpha[lo:hi] * beta
        p /= p.sum(axis=1, keepdims=True)
        if words:  # this step's forward values are not needed again
            alpha[lo:hi] = p
        sums[: hi - lo] += p
    if not words:
        return sums[rank], expected, p, norm
    return alpha[place], expected * step, p.sum(axis=0), norm


def potentials(s: np.ndarray) -> np.ndarray:
    return np.exp(s - s.max(axis=1, keepdims=True)) + 1e-12


def posterior_sums(texts: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the words' posteriors for every text (rows) and language, and the words of each text."""
    words, index, counts = words_of(texts)
    sums = np.zeros((len(texts), len(model["langs"])))
    if len(index):
        some = counts > 0
        sums[some] = chains(potentials(scores(words, model)), index, counts[some], model["step"], model["start"], words=False)[0]
    return sums, counts


def train(texts: list[str | None], langs: list[str], rounds: int = 30) -> dict | None:
    """The model of labelled texts; None if there is no word to learn from."""
    names = sorted(set(langs))
    words, index, counts = words_of(pa.array(texts, pa.large_string()))
    if not len(index):
        return None
    k = len(names)
    label = np.repeat(np.array([names.index(x) for x in langs]), counts)
    feats = Features(words)
    often = Counter(dict(enumerate(np.bincount(index, minlength=len(words)).tolist())))
    lexicon = {words[i]: j for j, (i, n) in enumerate(sorted(often.items(), key=lambda x: (-x[1], words[x[0]]))[:LEXICON]) if n > 1}
    rows = np.array([lexicon.get(w, -1) for w in words])
    model = {"langs": names, "lexicon": lexicon, "grams": np.zeros((BUCKETS, k)), "known": np.zeros((max(1, len(lexicon)), k))}

    def word_scores() -> np.ndarray:
        s = feats.score(model["grams"])
        s[rows >= 0] += model["known"][rows[rows >= 0]]
        return s

    memory: dict[str, list] = {}

    def ascend(name: str, grad: np.ndarray, i: int, rate: float) -> None:
        """One step of Adam."""
        m, v = memory.setdefault(name, [np.zeros_like(grad), np.zeros_like(grad)])
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        model[name] = model[name] + rate * (m / (1 - 0.9 ** (i + 1))) / (np.sqrt(v / (1 - 0.99 ** (i + 1))) + 1e-8)

    def word_step(grad: np.ndarray, i: int, rate: float) -> None:
        grad = grad / len(index)
        ascend("grams", feats.pull(grad) - 1e-6 * model["grams"], i, rate)
        known = np.zeros_like(model["known"])
        known[rows[rows >= 0]] = grad[rows >= 0]
        ascend("known", known - 1e-6 * model["known"], i, rate)

    def by_word(values: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(index, v, len(words)) for v in values.T], axis=1)

    seen = by_word(np.eye(k)[label])
    for i in range(rounds):  # words on their own, labelled as their documents
        s = potentials(word_scores())
        word_step(seen - s / s.sum(axis=1, keepdims=True) * seen.sum(axis=1, keepdims=True), i, 0.1)
    memory.clear()
    stay = np.full((k, k), 0.02 / max(1, k - 1)) + np.eye(k) * (0.98 - 0.02 / max(1, k - 1))
    post = chains(potentials(word_scores()), index, counts[counts > 0], stay, np.full(k, 1 / k))[0]
    label = post.argmax(axis=1)
    # sequences of bounded length for the chain's training
    parts = [min(TRAIN_WORDS, n - lo) for n in counts.tolist() for lo in range(0, n, TRAIN_WORDS)]
    seq = np.array(parts, np.int64)
    begins = np.cumsum(seq) - seq
    inner = np.ones(len(index), bool)
    inner[begins] = False
    moves = np.zeros((k, k))
    np.add.at(moves, (label[np.flatnonzero(inner) - 1], label[inner]), 1)
    firsts = np.bincount(label[begins], minlength=k).astype(float)
    seen = by_word(np.eye(k)[label])
    model["moves"], model["first"] = np.log(stay), np.log(np.full(k, 1 / k))
    for i in range(rounds // 2):
        post, pairs, first, _ = chains(potentials(word_scores()), index, seq, np.exp(model["moves"]), np.exp(model["first"]))
        word_step(seen - by_word(post), i, 0.03)
        ascend("moves", (moves - pairs) / len(index) - 1e-6 * model["moves"], i, 0.1)
        ascend("first", (firsts - first) / len(seq) - 1e-6 * model["first"], i, 0.1)
    step = np.exp(model.pop("moves"))
    start = np.exp(model.pop("first"))
    return model | {"step": step / step.sum(axis=1, keepdims=True), "start": start / start.sum(), "grams": model["grams"].astype(np.float32)}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Train on at most ``sample`` documents that are not held out and have a language, each of at most LONGEST bytes and
    all together of at most SAMPLE_BYTES; of an id's several texts the first by (language, text)."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    ids = known.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    one = rows.where(F.octet_length("text") <= LONGEST).groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("row"))  # ``sample`` rows at most
    so_far = F.sum(F.octet_length("row.text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    found = one.withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_BYTES).orderBy("doc_id").collect()
    return train([r["row"]["text"] for r in found], [r["row"]["lang"] for r in found])


def language(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (columns doc_id, text, lang)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(learn(docs, sample))  # its size is set by BUCKETS, LEXICON and the languages

    def run(batches):
        model = shared.value
        for b in batches:
            for lo, hi in slices(b.column(2), SLICE_BYTES):
                ids, held, texts = (c.slice(lo, hi - lo) for c in b.columns)
                names, score = ["und"] * (hi - lo), np.zeros(hi - lo)
                if model is not None:
                    sums, counts = posterior_sums(texts, model)
                    best = sums.argmax(axis=1)
                    score = np.where(counts > 0, sums[np.arange(hi - lo), best] / np.maximum(1, counts), 0.0)
                    names = [model["langs"][i] if n else "und" for i, n in zip(best.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, held, pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def drop_unknown(docs: DataFrame, least: float = 0.35, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of at least ``least``, with all their columns.

    Without a model (nothing could be learned) every text with a letter stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, sample))
    at = docs.columns.index("text")

    def run(batches):
        model = shared.value
        for b in batches:
            for lo, hi in slices(b.column(at), SLICE_BYTES):
                part = b.slice(lo, hi - lo)
                if model is None:
                    kept = words_of(part.column(at))[2] > 0
                else:
                    sums, counts = posterior_sums(part.column(at), model)
                    kept = (counts > 0) & (sums.max(axis=1) >= least * counts)
                yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
