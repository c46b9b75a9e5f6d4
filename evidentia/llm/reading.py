"""Reading level of each document: sentence classifiers over words and characters, calibrated per document."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.common import spread
from evidentia.llm.leakage import plain

LEVELS = 4
#: Hashed features; gradings the model is fitted on at most (a bounded sample, by hash of the document id); words a document needs.
FEATURES, SAMPLE, LEAST_WORDS = 1 << 15, 3_000, 40
L2, STEPS, ROUNDS = 2e-5, 150, 2

#: Function words by which running text of a language is known.
_ENGLISH = frozenset("the of and to in that is was were with for by a an it we are be from which at as on not but can has have had this these those such its their his her he she they if when then than or so what how who where there will would you your i our us do does did been into over under through after before between while because although until near again more most some all each no one two first out up down about them him may might must could should only also both many few other".split())
_FOREIGN = frozenset(
    "der die das und ist nicht ein eine einen einem einer den dem des von mit auf für wir haben hat aus noch zu zum zur im sich bei auch als wie an es sind wird werden nach oder aber über ergab "
    "le la les un une et est dans que qui pour pas sur au aux du des nous avons on ce cette ces son sa ses plus par avec ne se il elle ont été sont après où chaque "
    "el los las una uno unos y es en que de del por para con no se su sus al lo como más pero han hay porque esta este siguen otra vez hemos "
    "il lo gli di che e non per con una sono della dei nel het een van niet en zijn op te dat voor o os as um uma do da dos das em não com por mais foi".split()
) - {"a", "an", "on", "as", "no", "do", "in", "is", "was", "we", "so", "he", "of", "at", "not", "for", "con", "die", "more", "by", "been", "do", "most", "all", "to", "es", "me", "over", "per"}
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_BREAK = re.compile(r"(?<=[.!?])[\"”’')\]]*\s+|\n\s*\n|\n\s*(?:[-*•]|\d+[.)])\s+")
_YEAR = re.compile(r"\(\d{4}[a-z]?\)|\b(?:19|20)\d\d\b[.;,)]")
_PAGES = re.compile(r"\b\d+\s*(?:\(\d+\))?\s*[:,]\s*(?:pp?\.?\s*)?\d+\s*[-–]\s*\d+")


def words_in(text: str) -> list[str]:
    return _WORD.findall(text)


def is_english_prose(text: str, least: int = LEAST_WORDS) -> bool:
    """Whether a plain text is running English prose of at least `least` words: function words are English and common enough, it is no table (tabs,
    bars, numbers) and no reference list (years and page ranges in most lines)."""
    ws = words_in(text)
    n = len(ws)
    if n < least:
        return False
    low = [w.lower() for w in ws]
    en, other = sum(w in _ENGLISH for w in low), sum(w in _FOREIGN for w in low)
    if en < 0.02 * n or other > 0.5 * en:
        return False
    if text.count("\t") + text.count("|") > 0.12 * n or len(re.findall(r"(?<!\w)\d[\d.,]*(?!\w)", text)) > 0.3 * n:
        return False
    return len(_YEAR.findall(text)) + len(_PAGES.findall(text)) <= 0.06 * n


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence, lower case; headings and numbers give none."""
    out = [[w.lower() for w in words_in(s)] for s in _BREAK.split(text)]
    return [s for s in out if s]


def _hash(s: str) -> int:
    return zlib.crc32(s.encode()) % FEATURES


def features(word: str) -> list[int]:
    """The word and its character 3- and 4-grams with word ends."""
    w = f"<{word[:40]}>"
    return [_hash("w" + word)] + [_hash(w[i : i + n]) for n in (3, 4) for i in range(len(w) - n + 1)]


class Model:
    """Softmax over the mean word score of a sentence; a word's score is its own weight plus the mean weight of its character grams."""

    def __init__(self) -> None:
        self.w = np.zeros((FEATURES, LEVELS), np.float32)
        self.bias = np.zeros(LEVELS)
        self.doc = np.eye(LEVELS) * 4
        self.doc_bias = np.zeros(LEVELS)
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, LEVELS))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "table")} | {"known": {}, "table": np.zeros((0, LEVELS))}

    def rows(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if len(self.known) + len(new) > 300_000:
            self.known, self.table, new = {}, np.zeros((0, LEVELS)), list(dict.fromkeys(words))
        if new:
            at = len(self.known)
            add = []
            for k, w in enumerate(new):
                f = features(w)
                self.known[w] = at + k
                add.append(self.w[f[0]] + (self.w[f[1:]].mean(0) if len(f) > 1 else 0))
            self.table = np.vstack([self.table, np.array(add)])
        return self.table[[self.known[w] for w in words]]

    def document(self, text: str) -> np.ndarray:
        """Mean distribution of the sentences' levels, long sentences counting more, up to 25 words."""
        ss = sentences(text)
        if not ss:
            return np.full(LEVELS, 1 / LEVELS)
        r = self.rows([w for s in ss for w in s])
        ends = np.cumsum([len(s) for s in ss])
        total = np.add.reduceat(r, np.concatenate([[0], ends[:-1]]), axis=0)
        n = np.array([len(s) for s in ss])[:, None]
        p = _softmax(total / n + self.bias)
        weight = np.minimum(n, 25)
        return (p * weight).sum(0) / weight.sum()

    def levels(self, dist: np.ndarray) -> np.ndarray:
        return _softmax(dist @ self.doc + self.doc_bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _adam(params: list[np.ndarray], grad, steps: int, rate: float) -> None:
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        for k, g in enumerate(grad()):
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.001 * (g * g - v[k])
            params[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(params[k].dtype)


def fit(texts: list[str], gradings: list[list[tuple[str, int]]]) -> Model:
    """A model from graded documents. gradings: (grader, level) pairs of each text. Each grader's confusions are estimated beside the model, so
    a grader who errs or shifts counts for less; sentences take the level distribution of their document."""
    model = Model()
    docs = [sentences(t) for t in texts]
    vocab: dict[str, int] = {}
    word, sent, of = [], [], []
    for d, ss in enumerate(docs):
        for s in ss:
            k = len(of)
            of.append(d)
            for w in s:
                word.append(vocab.setdefault(w, len(vocab)))
                sent.append(k)
    word, sent, of = np.array(word), np.array(sent), np.array(of)
    feat, share, owner = [], [], []
    for w, k in vocab.items():
        f = features(w)
        feat += f
        share += [1.0] + [1 / max(1, len(f) - 1)] * (len(f) - 1)
        owner += [k] * len(f)
    feat, share, owner = np.array(feat), np.array(share)[:, None], np.array(owner)
    size = np.bincount(sent, minlength=len(of))[:, None]
    per_doc = np.bincount(of, minlength=len(docs))[:, None]
    graders = {g: k for k, g in enumerate(sorted({g for x in gradings for g, _ in x}))}
    votes = np.zeros((len(docs), LEVELS))
    for d, x in enumerate(gradings):
        for _, y in x:
            votes[d, y - 1] += 1
    target = (votes + 0.05) / (votes + 0.05).sum(1, keepdims=True)

    def fold(x: np.ndarray, by: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(by, x[:, c], n) for c in range(LEVELS)], 1)

    for k in range(ROUNDS + 1):
        state = {}

        def grad() -> list[np.ndarray]:
            e = fold(model.w[feat] * share, owner, len(vocab))
            p = _softmax(fold(e[word], sent, len(of)) / size + model.bias)
            state["p"] = p
            err = (p - target[of]) / per_doc[of] / len(docs)
            gw = fold((err / size)[sent], word, len(vocab))
            return [fold(gw[owner] * share, feat, FEATURES) + L2 * model.w, err.sum(0)]  # noqa: B023

        _adam([model.w, model.bias], grad, STEPS if k == 0 else STEPS // 3, 0.05)
        weight = np.minimum(size, 25)
        dist = fold(state["p"] * weight, of, len(docs)) / np.maximum(np.bincount(of, weight[:, 0], len(docs)), 1e-9)[:, None]

        def calibrate() -> list[np.ndarray]:
            err = (model.levels(dist) - target) / len(docs)
            return [dist.T @ err + 1e-4 * model.doc, err.sum(0)]  # noqa: B023

        _adam([model.doc, model.doc_bias], calibrate, 400, 0.05)
        # what each grader says for each true level, then the level of each document given model and graders
        prior = model.levels(dist)
        conf = np.ones((len(graders), LEVELS, LEVELS)) * 0.3 + np.eye(LEVELS) * 2
        for d, x in enumerate(gradings):
            for g, y in x:
                conf[graders[g], :, y - 1] += target[d]
        conf /= conf.sum(2, keepdims=True)
        log = np.log(prior + 1e-6)
        for d, x in enumerate(gradings):
            for g, y in x:
                log[d] += np.log(conf[graders[g], :, y - 1])
        target = _softmax(log)
    return model


def train(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, grader: str, level: str, sample: int = SAMPLE) -> Model | None:
    """A model from the gradings of documents that are English prose; None if there are none. At most `sample` graded documents, drawn by hash of their id."""
    good = labels.where(F.col(level).between(1, LEVELS) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.coalesce(F.col(grader), F.lit("")).alias("g"), F.col(level).alias("y")).distinct()
    graded = good.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("g", "y"))).alias("x")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # `sample` rows at most, so they may be broadcast and the texts stay where they are
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("t")).join(F.broadcast(graded), "_id").orderBy("_id").collect()
    texts, gradings = [], []
    for r in rows:
        p = plain(r["t"] or "")
        if is_english_prose(p):
            texts.append(p)
            gradings.append([(g, y) for g, y in r["x"]])
    return fit(texts, gradings) if texts else None


def reading_levels(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, grader: str, level: str) -> DataFrame:
    """(doc_id, reading_level, confidence, p1..p4): every document of running English prose with its level from 1, easiest, to 4.

    Each sentence is classified by a regularised softmax over words and character grams; the sentence distributions of a document, weighted by
    length, are calibrated to the graders' scale. The model, half a megabyte whatever the corpus, goes to the tasks; documents are read once and
    never moved. Null, empty and short texts, other languages, tables and reference lists give no rows; without usable gradings there are none at all.
    Blank gradings and levels outside 1..4 are left out. Very long texts are read whole.
    """
    schema = f"{doc_id} bigint, reading_level int, confidence double, p1 double, p2 double, p3 double, p4 double"
    model = train(docs, doc_id, text, labels, grader, level)
    if model is None:
        return docs.sparkSession.createDataFrame([], schema)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for b in batches:
            rows = []
            for d, t in zip(b[doc_id], b[text]):
                p = plain(t) if t else ""
                if is_english_prose(p):
                    z = m.levels(m.document(p))
                    rows.append((d, int(z.argmax()) + 1, float(z.max()), *map(float, z)))
            yield pd.DataFrame(rows, columns=[doc_id, "reading_level", "confidence", "p1", "p2", "p3", "p4"])

    return spread(docs.select(doc_id, text)).mapInPandas(score, schema)
