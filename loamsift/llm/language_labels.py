"""Languages of documents and of their lines, by a linear-chain conditional random field over words.

Words (runs of letters, lower case, look-alike letters undone) have features for identity, affixes,
character n-grams and a lexicon of frequent words. The weights and the transitions between the labels
of neighbours are learned by maximum likelihood from labelled samples and from sequences joined of
them, so that the chain learns how rarely a language changes within a line. Forward-backward gives
each word its label probabilities; their sums over a line and a document give language and
confidence. Made-up names, which look alike in all languages, take the language of their neighbours.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches
from .chars import LETTER, SPACE, Block, blocks, classes
from .confusables import LOOK_ALIKES

#: Samples that are fitted at most, in order of a seeded hash.
MAX_SAMPLES = 5000

# ISO 639 codes and names of the languages of the tables.
NAMES = {
    "en": ("en", "eng", "english"),
    "ko": ("ko", "kor", "korean", "한국어"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français"),
    "es": ("es", "spa", "spanish", "español"),
    "pt": ("pt", "por", "portuguese", "português"),
}
#: Labels that say nothing.
NOTHING = ("", "-", "und", "unknown", "xx", "zxx", "mul", "none", "null", "n/a", "?")

_UNDO = str.maketrans({a: b for many, one in LOOK_ALIKES.items() for a, b in zip(many.lower(), one.lower())})
_ODD = re.compile("[̀-ͯͰ-ԯᄀ-ᇿﬀ-ﬆ！-～]")
_HIDDEN = re.compile("[­​-‍⁠﻿]")


def plain(text: str | None) -> str:
    """Lower case without look-alikes and invisible characters; line breaks stay where they are."""
    if not text:
        return ""
    text = text.lower()
    if text.isascii():
        return text
    if _HIDDEN.search(text):
        text = _HIDDEN.sub("", text)
    return unicodedata.normalize("NFKC", text).translate(_UNDO) if _ODD.search(text) else text


def features(word: str, lexicon: dict[str, str]) -> list[str]:
    w = f"^{word}$"
    out = ["", f"w{word}", f"p{word[:3]}", f"s{word[-3:]}", f"p{word[:2]}", f"s{word[-2:]}"]
    out += [f"n{w[i : i + n]}" for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)]
    if "가" <= word[0] <= "힣":
        out.append("hangul")
    if word in lexicon:
        out += [f"l{lang}" for lang in lexicon[word].split()]
    return out


def _steps(length: np.ndarray) -> list[int]:
    """How many of the chains, longest first, reach each step."""
    return [int(np.searchsorted(-length, -t, "left")) for t in range(int(length[0]) if len(length) else 0)]


def forward_backward(scores: np.ndarray, first: np.ndarray, length: np.ndarray, transitions: np.ndarray, begin: np.ndarray):
    """Label probabilities of every word, log normalizer of every chain, and expected transitions.

    scores: words x labels; a chain is scores[first:first + length], chains in descending length.
    """
    k = scores.shape[1]
    top = scores.max(axis=1, keepdims=True)
    e = np.exp(scores - top)
    a = np.exp(transitions)
    alpha, scale = np.zeros_like(e), np.ones(len(e))
    steps = _steps(length)
    for t, n in enumerate(steps):
        at = first[:n] + t
        x = (np.exp(begin)[None, :] if t == 0 else alpha[at - 1] @ a) * e[at]
        s = x.sum(axis=1)
        alpha[at], scale[at] = x / s[:, None], s
    beta = np.ones_like(e)
    pairs = np.zeros((k, k))
    for t in range(len(steps) - 2, -1, -1):
        n = steps[t + 1]
        at = first[:n] + t
        ahead = e[at + 1] * beta[at + 1] / scale[at + 1][:, None]
        beta[at] = ahead @ a.T
        pairs += a * (alpha[at].T @ ahead)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=1, keepdims=True)
    return gamma, np.log(scale) + top[:, 0], pairs


class LanguageModel:
    """A fitted field; a word's scores are kept once computed."""

    def __init__(self, langs: list[str], index: dict[str, int], weights: np.ndarray, transitions: np.ndarray, begin: np.ndarray, lexicon: dict[str, str]):
        self.langs, self.index, self.weights, self.transitions, self.begin, self.lexicon = langs, index, weights, transitions, begin, lexicon

    def word_scores(self, word: str) -> np.ndarray:
        at = [i for f in features(word, self.lexicon) if (i := self.index.get(f)) is not None]
        return self.weights[at].sum(axis=0)

    @classmethod
    def fit(cls, samples: list[tuple[str, str]], lexicon: dict[str, str], epochs: int = 60, joined: int = 3, penalty: float = 2e-4, seed: int = 5) -> LanguageModel:
        """samples: (language, text). ``joined`` sequences for each sample are made of one to three samples."""
        rng = np.random.default_rng(seed)
        langs = sorted({lang for lang, _ in samples})
        split = [(langs.index(lang), words) for lang, text in samples if (words := re.findall(r"[^\W\d_]+", plain(text)))]
        sequences = [[s] for s in split]
        for _ in range(joined * len(split)):
            sequences.append([split[i] for i in rng.integers(len(split), size=rng.integers(1, 4))])
        sequences.sort(key=lambda s: -sum(len(w) for _, w in s))
        length = np.array([sum(len(w) for _, w in s) for s in sequences])
        first = np.concatenate(([0], np.cumsum(length)[:-1]))
        truth = np.array([y for s in sequences for y, words in s for _ in words])
        flat = [w for s in sequences for _, words in s for w in words]
        distinct = sorted(set(flat))
        index: dict[str, int] = {}
        at, owner = [], []
        for n, w in enumerate(distinct):
            for f in features(w, lexicon):
                at.append(index.setdefault(f, len(index)))
                owner.append(n)
        at, owner = np.array(at), np.array(owner)
        number = {w: n for n, w in enumerate(distinct)}
        word = np.array([number[w] for w in flat])
        k = len(langs)
        w, a, b = np.zeros((len(index), k)), np.zeros((k, k)), np.zeros(k)
        sums = [np.full_like(x, 1e-3) for x in (w, a, b)]
        starts = first
        same = np.zeros(len(flat), bool)
        same[1:] = True
        same[starts] = False
        pair_truth = np.zeros((k, k))
        np.add.at(pair_truth, (truth[:-1][same[1:]], truth[1:][same[1:]]), 1)
        hot = np.eye(k)[truth]
        for _ in range(epochs):
            scores = np.stack([np.bincount(owner, w[at, y], len(distinct)) for y in range(k)], axis=1)
            gamma, _, pairs = forward_backward(scores[word], first, length, a, b)
            error = hot - gamma
            by_word = np.stack([np.bincount(word, error[:, y], len(distinct)) for y in range(k)], axis=1)
            grad_w = np.stack([np.bincount(at, by_word[owner, y], len(index)) for y in range(k)], axis=1) / len(flat) - penalty * w
            grads = (grad_w, (pair_truth - pairs) / len(flat) - penalty * a, error[starts].sum(axis=0) / len(flat) - penalty * b)
            for x, g, s in zip((w, a, b), grads, sums):
                s += g * g
                x += 0.3 * g / np.sqrt(s)
        return cls(langs, index, w.astype(np.float32), a, b, lexicon)


class _Scorer:
    """Scores of distinct words by hash, kept for the life of a task up to a limit."""

    KEEP = 300_000

    def __init__(self, model: LanguageModel):
        self.model = model
        self.hashes = np.zeros(0, np.uint64)
        self.scores = np.zeros((0, len(model.langs)), np.float32)

    def __call__(self, block: Block, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        h, head, which = np.unique(block.hashes(begin, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, h)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == h[known]
        scores = np.zeros((len(h), len(self.model.langs)), np.float32)
        scores[known] = self.scores[at[known]]
        new = np.flatnonzero(~known)
        for i in new.tolist():
            scores[i] = self.model.word_scores(block.joined[begin[head[i]] : end[head[i]]])
        if len(self.hashes) > self.KEEP:
            self.hashes, self.scores = h, scores
        elif len(new):
            merged = np.concatenate((self.hashes, h[new]))
            order = np.argsort(merged)
            self.hashes, self.scores = merged[order], np.concatenate((self.scores, scores[new]))[order]
        return scores[which]


# What may stand next to a word of running text, besides white space.
_BESIDE = ".,;:!?'\"()-–—…“”‘’„«»‹›¿¡、。·"


def _natural(block: Block, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether a run of letters stands by itself: not part of an address, a code, a number or a row of symbols."""
    cp = np.append(block.cp, [32, 32])
    fine = (classes()[cp] & SPACE) != 0
    fine |= np.isin(cp, [ord(c) for c in _BESIDE])
    dotted = (cp[:-1] == ord(".")) & ((classes()[cp[1:]] & LETTER) != 0)  # example.org
    dotted[block.start[1:] - 1] = False  # what follows is another text
    fine[:-1] &= ~dotted
    heads = np.isin(begin, block.start)
    inside = dotted[begin - 1] & ~heads
    left = fine[begin - 1] | heads
    right = fine[end] | np.isin(end, block.start)
    return left & right & ~inside


def word_labels(model: LanguageModel, score, block: Block):
    """Probabilities of each word's languages times the weight of its evidence, and the text and line (from 0) it is in; line is numbered through the block.

    A line is one chain, however long. The weight is near 0 for words that fit all languages alike, as
    names and random letters do.
    """
    begin, end, text = block.runs(LETTER)
    k = len(model.langs)
    breaks = np.cumsum(block.cp == 10)
    if len(begin):
        fine = _natural(block, begin, end)
        begin, end, text = begin[fine], end[fine], text[fine]
    if not len(begin):
        return np.zeros((0, k)), text, text, breaks
    line = breaks[begin] + text  # a text's end is a line's end too
    scores = score(block, begin, end)
    new = np.ones(len(begin), bool)
    new[1:] = line[1:] != line[:-1]
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(begin)))
    order = np.argsort(-lengths, kind="stable")
    gamma = forward_backward(scores.astype(np.float64), starts[order], lengths[order], model.transitions, model.begin)[0]
    own = np.exp(scores - scores.max(axis=1, keepdims=True))
    weight = ((1 / own.sum(axis=1) - 1 / k) / (1 - 1 / k)) ** 2
    return gamma * weight[:, None], text, line, breaks


def fit_from_tables(samples: DataFrame, lexicon: DataFrame | None = None) -> LanguageModel | None:
    """samples: (lang, text), at most MAX_SAMPLES of them are fitted; lexicon: (lang, word), a small table. None without a sample that has a letter."""
    rows = samples.where("lang is not null and text is not null").select("lang", "text").orderBy(F.xxhash64("text"), "text", "lang").limit(MAX_SAMPLES).collect()
    words: dict[str, list[str]] = {}
    for r in lexicon.where("lang is not null and word is not null").select("lang", "word").distinct().collect() if lexicon is not None else ():
        words.setdefault(r.word.lower(), []).append(r.lang)
    rows = [r for r in rows if re.search(r"[^\W\d_]", plain(r.text))]
    return LanguageModel.fit([(r.lang, r.text) for r in rows], {w: " ".join(sorted(x)) for w, x in words.items()}) if rows else None


def label_languages(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", min_words: int = 8, surely: float = 0.65, least: float = 0.2) -> DataFrame:
    """(id, line_no, label, lang, confidence, evidence): a row 0 for each document with letters, and one for each line of min_words blank-separated words or more in another language than the document.

    A line counts with a confidence of ``surely`` or more, and evidence of two words and of the share
    ``least`` of its words: rows of names and product tags have less.

    Lines are split at \\n and numbered from 1. label is the document's own label, as stored. Null
    and blank texts, and texts without letters, give no row. A tie goes to the language of the first
    code in alphabetical order. Rows with equal ids are labelled one by one. No model gives no row.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    langs = pa.array(model.langs if model else [], pa.string())
    sent = docs.sparkSession.sparkContext.broadcast(model)  # grows with the samples, not with the documents

    def make():
        m = sent.value
        score = m and _Scorer(m)

        def each(batch):
            if m is None:
                return
            for first, block in blocks([plain(t) for t in batch.column(2).to_pylist()]):
                n = len(block.texts)
                gamma, text, line, breaks = word_labels(m, score, block)
                if not len(text):
                    continue
                per_text = np.stack([np.bincount(text, g, n) for g in gamma.T], axis=1)
                total = per_text.sum(axis=1)
                main = per_text.argmax(axis=1)
                ids, labels = batch.column(0).slice(first, n), batch.column(1).slice(first, n)
                some = np.flatnonzero(total > 0)
                yield {
                    "_id": ids.take(pa.array(some)),
                    "line_no": np.zeros(len(some), np.int64),
                    "label": labels.take(pa.array(some)),
                    "lang": langs.take(pa.array(main[some])),
                    "confidence": per_text[some, main[some]] / total[some],
                    "evidence": total[some],
                }
                # lines: number, languages, blank-separated words
                lines = int(line[-1]) + 1
                per_line = np.stack([np.bincount(line, g, lines) for g in gamma.T], axis=1)
                space = (classes()[block.cp] & SPACE) != 0
                word = ~space
                word[1:] &= space[:-1]
                inner = block.start[1:-1][block.start[1:-1] < len(space)]
                word[inner] = ~space[inner]
                at = np.flatnonzero(word)
                words = np.bincount(breaks[at] + np.searchsorted(block.start, at, "right") - 1, minlength=lines)[:lines]
                heads = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
                of = text[heads]
                number = line[heads]
                best = per_line[number].argmax(axis=1)
                evidence = per_line[number].sum(axis=1)
                sure = (per_line[number, best] >= surely * evidence) & (evidence >= np.maximum(2.0, least * words[number]))
                other = np.flatnonzero((best != main[of]) & (words[number] >= min_words) & sure)
                # lines before the text: its own number of breaks before it, and one for each text
                before = np.concatenate(([0], breaks))[block.start[:-1]] + np.arange(n)
                yield {
                    "_id": ids.take(pa.array(of[other])),
                    "line_no": number[other] - before[of[other]] + 1,
                    "label": labels.take(pa.array(of[other])),
                    "lang": langs.take(pa.array(best[other])),
                    "confidence": per_line[number[other], best[other]] / evidence[other],
                    "evidence": evidence[other],
                }

        return each

    rows = docs.select(F.col(id_col).alias("_id"), F.col(label_col).cast("string").alias("_label"), F.col(text_col).alias("_text"))
    return map_batches(rows, make, f"_id {kind}, line_no long, label string, lang string, confidence double, evidence double").withColumnRenamed("_id", id_col)


def known_language(label, names: dict[str, tuple[str, ...]] = NAMES):
    """The language a stored label names, by code or name, without regard to case and region; null where it names none of these."""
    base = F.split(F.lower(F.trim(label)), "[-_]", 2)[0]
    out = F.lit(None).cast("string")
    for lang, spellings in names.items():
        out = F.when(base.isin(list(spellings)), lang).otherwise(out)
    return out


def wrong_labels(labelled: DataFrame, id_col: str = "doc_id", surely: float = 0.6, least: float = 3.0) -> DataFrame:
    """(id, line_no, lang, confidence): documents of label_languages whose label says nothing or names another language, and all its lines.

    A label that names a language is only contradicted with a confidence of ``surely`` and the
    evidence of ``least`` words: a page of figures under a short title keeps its label.
    """
    known = known_language(F.col("label"))
    says_nothing = F.coalesce(F.lower(F.trim("label")), F.lit("")).isin(list(NOTHING))
    wrong = ~F.col("lang").eqNullSafe(known) & (says_nothing | ((F.col("confidence") >= surely) & (F.col("evidence") >= least)))
    return labelled.where((F.col("line_no") > 0) | wrong).select(id_col, "line_no", "lang", "confidence")
