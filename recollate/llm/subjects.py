"""Subject areas of documents: classifier chains over term, source and structure features.

Training (on the driver, on at most ``sample`` documents, labelled ones first, a bounded and documented parameter)
1. Term weights: a naive Bayes model over the words of a sentence (character pairs for scripts without spaces), classes none and
   the subjects, fitted by expectation maximisation with the documents' labels as priors of their sentences.
2. A classifier chain: boosted trees per subject in order of frequency. Their features are of three kinds: terms (the subject's term weights
   summed over the document, per sentence, and in its strongest sentences; how many and what share of its sentences they favour; the same of the
   strongest other subject), structure (number of sentences, kind, language) and source; and the subjects before it in the chain, which
   models co-occurrence. What amount of a subject makes a document deal with it is learned from the labels alone.
   Each model is calibrated by its own intercept and slope on held-out folds.
Inference (on the workers, over whole texts): label combinations are decoded by beam search over the chain.

Null, empty and wordless texts have no subject; null language, kind or source are a value of their own. Every document
gets its own answer, so ties and repeated rows don't matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollate.llm.boosting import Trees, fit_trees

SAMPLE, ROUNDS, LEAST_DOCS = 4000, 8, 2
#: Label combinations kept per document while decoding; one less likely than the best by more than a factor of exp(GAP) is dropped, too.
BEAM, GAP = 8, 9.0
_NOISE = re.compile(r"\A---\r?\n(?s:.*?)\n---\r?$|^[ \t]*(?:#{1,6} |\*\*\w+\*\*|\[\w+:|```|\|).*$", re.M)
_TOKEN = re.compile(r"[^\W\d_]+|[.!?](?=\s)|[。！？]|\n")
_WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")
_RUN = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]+|[^\u3040-\u30ff\u3400-\u9fff]+")
_ENDS = frozenset(".!?。！？\n")
_END, _UNKNOWN = -1, -2


def tokens(text: str) -> list[str]:
    """Terms and sentence ends of a document, without front matter, headings, speaker, tool and table lines.

    A term is a lower-case word, or a pair of neighbouring characters in a run of wide script.
    """
    found = _TOKEN.findall(_NOISE.sub("\n", text).lower())
    if not _WIDE.search(text):
        return found
    out: list[str] = []
    for t in found:
        for run in _RUN.findall(t) if t not in _ENDS else ():
            out += [run[i : i + 2] for i in range(len(run) - 1)] or [run] if _WIDE.match(run) else [run]
        if t in _ENDS:
            out.append(t)
    return out


def numbered(texts: list[str], number: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, its sentence) of all known terms, and (document) of every sentence with a word, and the number of sentences of each document."""
    table = {**number, **dict.fromkeys(_ENDS, _END)}
    parts = []
    for t in texts:
        toks = tokens(t) if t else []
        toks.append("\n")
        parts.append(np.fromiter(map(table.get, toks, repeat(_UNKNOWN)), np.int32, len(toks)))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    end = ids == _END
    chunk = np.cumsum(end) - end
    words = ~end
    filled = np.flatnonzero(np.bincount(chunk[words], minlength=int(chunk[-1]) + 1 if len(chunk) else 0))
    place = np.full(int(chunk[-1]) + 1 if len(chunk) else 0, -1, np.int64)
    place[filled] = np.arange(len(filled))
    known = ids >= 0
    of_doc = np.zeros(len(filled), np.int64)
    of_doc[place[chunk[words]]] = doc[words]
    return ids[known], place[chunk[known]], of_doc, np.bincount(of_doc, minlength=len(texts))


@dataclass
class SentenceModel:
    """Log ratios of terms to their overall share under each class, class 0 being none."""

    number: dict[str, int]
    weights: np.ndarray
    prior: np.ndarray

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term scores by class) of every sentence, and the number of sentences of each document."""
        ids, own, of_doc, sizes = numbered(texts, self.number)
        scores = np.empty((len(of_doc), len(self.prior)))
        for c in range(len(self.prior)):
            scores[:, c] = np.log(self.prior[c]) + np.bincount(own, self.weights[ids, c], len(of_doc))
        return of_doc, scores, sizes


def fit_sentences(texts: list[str], labels: list[set[int] | None], classes: int, rounds: int = ROUNDS) -> SentenceModel:
    """EM: sentences of a document deal with nothing, with one of its labels, or rarely with another subject; labels None: any.

    It starts from how far a term's documents favour a subject, so that terms of a language never pass for a subject's.
    """
    seen: Counter = Counter()
    for t in texts:
        seen.update(set(tokens(t or "")) - _ENDS)
    number = {w: i for i, w in enumerate(w for w, n in seen.items() if n >= LEAST_DOCS)}
    if not number:
        return SentenceModel({}, np.zeros((0, classes + 1)), np.full(classes + 1, 1 / (classes + 1)))
    ids, own, of_doc, _ = numbered(texts, number)
    prior = np.full((len(texts), classes + 1), 0.03 / classes)
    for i, mine in enumerate(labels):
        prior[i, 0] = 0.97 if mine == set() else 0.72
        for k in mine if mine is not None else range(classes):
            prior[i, k + 1] += 0.25 / (len(mine) if mine is not None else classes)
    prior /= prior.sum(1, keepdims=True)
    by_doc = prior[of_doc]
    # Start: in how many documents with a label does the term occur, against all of its documents.
    pairs = np.unique(of_doc[own] * np.int64(len(number)) + ids)
    d, w = pairs // len(number), pairs % len(number)
    known = np.array([mine is not None for mine in labels])
    d, w = d[known[d]], w[known[d]]
    member = np.zeros((len(texts), classes))
    for i, mine in enumerate(labels):
        member[i, list(mine or ())] = 1
    base = (member[known].mean(0) if known.any() else np.zeros(classes)) + 1e-6
    n_docs = np.bincount(w, minlength=len(number)).astype(float)
    weights = np.zeros((len(number), classes + 1))
    for c in range(classes):
        rate = (np.bincount(w, member[d, c], len(number)) + 2 * base[c]) / (n_docs + 2)
        sure = np.maximum(rate - 0.3 * np.sqrt(rate * (1 - rate) / (n_docs + 2)), 1e-6)
        weights[:, c + 1] = np.where(sure > 2.5 * base[c], np.log(sure / base[c]), -0.5)
    for _ in range(rounds):
        scores = np.log(by_doc)
        for c in range(classes + 1):
            scores[:, c] += np.bincount(own, weights[ids, c], len(of_doc))
        scores -= scores.max(1, keepdims=True)
        post = np.exp(scores)
        post /= post.sum(1, keepdims=True)
        counts = np.stack([np.bincount(ids, post[own, c], len(number)) for c in range(classes + 1)], 1)
        share = counts.sum(1, keepdims=True) / counts.sum()
        # Smoothed towards the term's overall share, so a term seen once says little.
        weights = np.log((counts + 30 * share + 1e-12) / (counts.sum(0, keepdims=True) + 30)) - np.log(share)
    mean = post.mean(0) + 1e-6
    return SentenceModel(number, weights, mean / mean.sum())


PER_SUBJECT = 9


def term_features(of_doc: np.ndarray, scores: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents x subjects x PER_SUBJECT, documents x 3): what the terms of a document say of each subject, and of its structure."""
    docs, subjects = len(sizes), scores.shape[1] - 1
    n = np.maximum(1, sizes).astype(float)
    shifted = np.exp(scores - scores.max(1, keepdims=True)) if len(scores) else scores
    soft = shifted / shifted.sum(1, keepdims=True) if len(scores) else scores
    best = scores.argmax(1) if len(scores) else np.zeros(0, int)
    lead = scores[:, 1:] - scores[:, :1]  # log odds of a subject against none
    count = np.bincount(of_doc * (subjects + 1) + best, minlength=docs * (subjects + 1)).reshape(docs, subjects + 1).astype(float)
    out = np.zeros((docs, subjects, PER_SUBJECT))
    rest = np.zeros(docs)
    order = np.argsort(of_doc, kind="stable")
    starts = np.searchsorted(of_doc[order], np.arange(docs))
    filled = np.flatnonzero(sizes > 0)
    share = count[:, 1:] / n[:, None]
    for k in range(subjects):
        total = np.bincount(of_doc, soft[:, k + 1], docs)
        weight = np.bincount(of_doc, np.clip(lead[:, k], -6, 12), docs)
        top = np.zeros(docs)
        if len(filled):
            top[filled] = np.maximum.reduceat(lead[order, k], starts[filled])
        others = np.delete(share, k, axis=1)
        rest = others.max(1) if others.shape[1] else rest
        out[:, k] = np.stack([count[:, k + 1], share[:, k], total, total / n, weight, weight / n, top, rest, count[:, k + 1] - np.delete(count[:, 1:], k, axis=1).max(1, initial=0)], 1)
    return out, np.stack([sizes, count[:, 0] / n, (count[:, 1:] > 0).sum(1)], 1)


@dataclass
class Chain:
    """Boosted trees in chain order; model j sees the base features and the decisions of the models before it."""

    subjects: list[str]
    order: list[int]
    sentence: SentenceModel
    codes: list[dict[str, int]]
    models: list[Trees] = field(default_factory=list)
    scales: list[tuple[float, float]] = field(default_factory=list)

    def one_hot(self, lang: list, source: list, kind: list) -> np.ndarray:
        out = np.zeros((len(lang), sum(map(len, self.codes))))
        at = 0
        rows = np.arange(len(lang))
        for code, values in zip(self.codes, (kind, lang, [(x or "").partition(":")[0] for x in source]), strict=True):
            out[rows, at + np.array([code.get(v or "", 0) for v in values], int)] = 1
            at += len(code)
        return out

    def base(self, texts: list[str], lang: list, source: list, kind: list) -> tuple[np.ndarray, np.ndarray]:
        """(features by document and subject, features of the document)."""
        terms, structure = term_features(*self.sentence.score(texts))
        return terms, np.column_stack([structure, self.one_hot(lang, source, kind)])

    def decode(self, texts: list[str], lang: list, source: list, kind: list, beam: int = BEAM) -> list[list[int]]:
        """The likeliest label combination of each document."""
        if not self.subjects or not texts:
            return [[] for _ in texts]
        terms, shared = self.base(texts, lang, source, kind)
        docs, width = len(texts), len(self.subjects)
        # All states of all documents side by side: whose they are, how likely, and which subjects they have decided on.
        doc, score, on = np.arange(docs), np.zeros(docs), np.zeros((docs, width))
        for j, k in enumerate(self.order):
            a, b = self.scales[j]
            z = a * self.models[j].raw(np.column_stack([terms[doc, k], shared[doc], on])) + b
            soft = np.log1p(np.exp(-np.abs(z)))
            yes = on.copy()
            yes[:, k] = 1
            doc, score, on = np.concatenate([doc, doc]), np.concatenate([score + np.minimum(z, 0) - soft, score - np.maximum(z, 0) - soft]), np.concatenate([yes, on])
            order = np.lexsort((-score, doc))
            doc, score, on = doc[order], score[order], on[order]
            first = np.searchsorted(doc, np.arange(docs))
            keep = (np.arange(len(doc)) - first[doc] < beam) & (score > score[first[doc]] - GAP)
            doc, score, on = doc[keep], score[keep], on[keep]
        best = np.searchsorted(doc, np.arange(docs))
        return [[k for k in self.order if on[i, k]] for i in best]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 40) -> np.ndarray:
    """Newton's method for ridge logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(rows: list[tuple], subjects: list[str], others: list[str] = ()) -> Chain:
    """rows: (text, labels as names, lang, source, kind). Half the folds fit, the other half calibrates. others: texts without labels, for the sentence model."""
    if not subjects:
        return Chain([], [], SentenceModel({}, np.zeros((0, 1)), np.ones(1)), [{"?": 0}, {"?": 0}, {"?": 0}])
    number = {s: i for i, s in enumerate(subjects)}
    labels = [{number[s] for s in r[1] if s in number} for r in rows]
    frequency = Counter(k for own in labels for k in own)
    order = sorted(range(len(subjects)), key=lambda k: (-frequency[k], k))

    def codes(values: list) -> dict[str, int]:
        return {v: i for i, v in enumerate(["?", *sorted({v for v in values if v})])}

    texts, lang, source, kind = ([r[i] for r in rows] for i in (0, 2, 3, 4))
    model = fit_sentences([*texts, *others], [*labels, *[None] * len(others)], len(subjects))
    chain = Chain(subjects, order, model, [codes(kind), codes(lang), codes([(x or "").partition(":")[0] for x in source])])
    terms, shared = chain.base(texts, lang, source, kind)
    member = np.zeros((len(rows), len(subjects)))
    for i, mine in enumerate(labels):
        member[i, list(mine)] = 1
    fold = np.arange(len(rows)) % 2
    for j, k in enumerate(order):
        seen = np.zeros_like(member)
        seen[:, order[:j]] = member[:, order[:j]]
        x, y = np.column_stack([terms[:, k], shared, seen]), member[:, k]
        if not 0 < y.sum() < len(y):
            chain.models.append(Trees(1, 4.0 if y.sum() else -4.0))
            chain.scales.append((1.0, 0.0))
            continue
        grow = lambda xs, ys: fit_trees(xs, ys, rounds=60, most_cuts=48)
        chain.models.append(grow(x, y))
        held = np.zeros(len(y))
        for f in (0, 1):
            held[fold == f] = grow(x[fold != f], y[fold != f]).raw(x[fold == f])
        a, b = _logistic(np.stack([np.clip(held, -12, 12), np.ones(len(y))], 1), y, ridge=0.5)
        chain.scales.append((max(float(a), 0.1), float(b)))
    return chain


def train(docs: DataFrame, labels: DataFrame, subjects: DataFrame, sample: int = SAMPLE) -> Chain:
    """The chain from at most ``sample`` documents, chosen by the hash of their ids, labelled ones first."""
    names = sorted({r[0] for r in subjects.select("subject").distinct().toLocalIterator() if r[0] is not None})
    own = labels.filter("doc_id IS NOT NULL AND subject IS NOT NULL").groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = docs.select("doc_id", "text", "lang", "source", "doc_kind").join(chosen, "doc_id").filter("text IS NOT NULL").dropDuplicates(["doc_id"])
    rows = sorted((r for r in picked.limit(sample).collect()), key=lambda r: r["doc_id"])
    # Where fewer are labelled, others fill up the sample for the sentence model.
    rest = docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL").join(own.select("doc_id"), "doc_id", "left_anti").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    others = [r["text"] for r in rest.collect()][: sample - len(rows)] if len(rows) < sample else []
    return fit([(r["text"], set(r["subjects"]), r["lang"], r["source"], r["doc_kind"]) for r in rows], names, others)


def assign(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, subject: one row per subject of a document."""
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(chain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = cloudpickle.loads(shared.value)
        for batch in batches:
            texts, langs, sources, kinds = (batch.column(c).to_pylist() for c in ("text", "lang", "source", "doc_kind"))
            rows, out = [], []
            for i, mine in enumerate(model.decode(texts, langs, sources, kinds)):
                for k in mine:
                    rows.append(i)
                    out.append(model.subjects[k])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int32())), pa.array(out, pa.string())], names=["doc_id", "subject"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", "text", "lang", "source", "doc_kind").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return source.mapInArrow(run, f"doc_id {kind}, subject string")
