"""Pages stitched from phrases that are replicated on other hosts, with the density of lists as evidence.

Three passes over the texts and two joins:

1. Phrase shingles of three words are taken from the rows without sentences of all pages, exploded, and
   their distinct hosts counted. They are taken as they are and with any word in the middle (a made-up
   name, a brand), so "shipping Dunrist desk" is a phrase in common with every other name. Words run
   together, as tags have them, give shingles of letters.
2. Of phrases on several hosts the pages that hold them anywhere are counted, exactly. Advertising
   phrases are those found in such rows on a good part of the pages that have them at all.
3. Every line of every body (see main_content) is measured, and the phrases in it are joined with the
   table of advertising phrases. A page is flagged if most of its body is rows stitched from them, or
   bare links and tags on a page that holds such replicated phrases, or hardly anything but these.

The tables of phrases stay distributed. Tasks get a filter of fixed size made of them (see filters), which
lets through every phrase of the table and some others; the exact joins come after it.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import list_array, map_batches
from .chars import LETTER, Block, blocks, mix
from .checkpoints import cut
from .filters import filter_of, maybe_in
from .language_labels import plain
from .line_classifier import LineModel, PageLines
from .line_shapes import LineShapes
from .main_content import body_mask

_U64 = np.uint64
_LINK = re.compile(r"(?:https?://|www\.)[^\s\)\]>]+")
_TAG = re.compile(r"(?:^|[\s,;|])(?:#|tag:)[^\W\d_]{3,}")
_CODE = re.compile(r"[{}=<>\[\]\\^~@]|;$|\w\(\w*\)|\b\d\d:\d\d\b")
_WORD = re.compile(r"[^\W\d_]+")
_BULLET = re.compile(r"^\s*(?:\d{1,4}[.)]|[-–•+●*■◆○□◇])\s")

PROSE, LINKS, TAGS, JUNK = range(4)
#: Share of a row's words at which an advertising phrase begins; the others are its further words and made-up names.
COVERAGE = 0.15
#: Share of a body that links and tags fill where they need no phrases of other hosts beside them.
ALONE = 0.8
#: Share of a line's words in what its sentences say more than once, above which they are none.
AGAIN = 0.4
#: Letters of a run that is no single word, and of the shingles in it; for Latin letters and for Hangul.
_TOGETHER, _PIECE = (14, 7), (7, 3)


class Phrases:
    """The phrase shingles of a block: hash, the number of the word that each begins with, and the line and text of the words."""

    def __init__(self, block: Block, shapes: LineShapes):
        begin, end, text = block.runs(LETTER)
        some = end - begin > 1
        begin, end, text = begin[some], end[some], text[some]
        self.text, n, lines = text, len(begin), len(shapes.chars)
        self.line = np.cumsum(block.cp == 10)[begin] + text if n else text
        h = block.hashes(begin, end)
        self.words = np.bincount(self.line, minlength=lines)
        self.address = np.zeros(lines, bool)
        self.address[self.line[np.isin(h, _address_words())]] = True
        unit, joined = _units(shapes, self.words, self.address)
        of = unit[self.line]
        far = np.concatenate((of, [-1, -2]))
        three = np.flatnonzero(far[2 : n + 2] == of)
        ends = _fold(2, h[three], h[three + 2])  # of any three words, whatever the middle one
        whole = _fold(1, ends, h[three + 1])
        # shingles of letters within words run together
        hangul = (block.cp[begin] >= 0xAC00) & (block.cp[begin] <= 0xD7A3) if n else np.zeros(0, bool)
        size = end - begin
        self.together = size >= np.where(hangul, _TOGETHER[1], _TOGETHER[0])
        long = np.flatnonzero(self.together)
        piece = np.where(hangul, _PIECE[1], _PIECE[0])[long]
        count = size[long] - piece + 1
        start = np.repeat(begin[long], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        pieces = _fold(5, block.hashes(start, start + np.repeat(piece, count))) if len(long) else np.zeros(0, _U64)
        self.hash = np.concatenate((whole, ends, pieces))
        self.at = np.concatenate((three, three, np.repeat(long, count)))
        stops = np.flatnonzero(np.logical_or.reduce([block.cp == ord(c) for c in ".!?。"]))
        sentence = np.searchsorted(stops, begin) + (self.line << 32)
        self._parts = shapes, h, size, unit, joined, three, whole, sentence

    @functools.cached_property
    def rows(self) -> np.ndarray:
        """Lines without a sentence: long ones without an end, addresses, tags, short lines that go on with few words, and lines whose sentences say the same again."""
        shapes, h, size, unit, joined, three, whole, sentence = self._parts
        lines = len(self.words)
        letters = np.bincount(self.line, size, lines)
        rows = self.address | ((np.bincount(self.line, size * self.together, lines) * 2 >= letters) & (letters > 0))
        if joined.any():
            inside = np.flatnonzero(joined[self.line])
            of = unit[self.line[inside]]
            _, which, times = np.unique(mix(h[inside] + mix(of.astype(_U64))), return_inverse=True, return_counts=True)
            often = np.bincount(of, times[which] >= 3, lines)
            rows |= (often * 2 >= np.maximum(1, np.bincount(of, minlength=lines)))[unit] & joined
        # phrases of three words said again in one sentence, and words said again between bars, as menus do not
        barred = shapes.bars >= 2
        for key, at, some, width in ((whole, three, (self.words >= 6) & shapes.ended, 3), (h, np.arange(len(h)), (self.words >= 6) & barred, 1)):
            inside = some[self.line[at]]
            key, at = key[inside], at[inside]
            if len(at):
                _, which, times = np.unique(mix(key + mix(sentence[at].astype(_U64))), return_inverse=True, return_counts=True)
                again = np.zeros(len(self.line) + 2, bool)
                for k in range(width):
                    again[at[times[which] >= 2] + k] = True
                rows |= some & (np.bincount(self.line, again[: len(self.line)], lines) >= AGAIN * np.maximum(1, self.words))
        return rows | (~shapes.ended & (self.words >= 6) & ~barred)

def _fold(salt: int, *hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return functools.reduce(lambda x, h: mix(x * _U64(0x9E3779B97F4A7C15) + h), hashes, np.full(len(hashes[0]), _U64(salt)))


def _units(shapes: LineShapes, words: np.ndarray, address: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The line at which what a line is part of begins, and whether it is joined: eight short lines or more in a row without a sentence end are read as one."""
    unit = np.arange(len(words))
    joined = np.zeros(len(words), bool)
    at = np.flatnonzero(~shapes.blank)
    short = (~shapes.ended & (words > 0) & (words < 6) & (shapes.bars == 0) & ~address)[at]
    if not short.any():
        return unit, joined
    new = np.concatenate(([True], (short[1:] != short[:-1]) | (shapes.text[at[1:]] != shapes.text[at[:-1]])))
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(at)))
    some = np.repeat(sizes >= 8, sizes) & short
    unit[at[some]] = np.repeat(at[heads], sizes)[some]
    joined[at[some]] = True
    return unit, joined


@functools.cache
def _address_words() -> np.ndarray:
    words = Block(["http", "https", "www"])
    return words.hashes(words.start[:-1], words.start[1:])


def replicated_phrases(docs: DataFrame, text_col: str = "text", host_col: str = "host", least_hosts: int = 3, least_pages: int = 3) -> DataFrame:
    """(phrase, hosts, pages) of the phrases that stand in rows without sentences on at least so many hosts and pages.

    Both floors are numbers, so pages are judged alike in a small and a large crawl. Pages without a
    host count as those of one host.
    """

    def collect():
        def each(batch):
            hosts = batch.column(0)
            for first, block in blocks([plain(t) for t in batch.column(1).to_pylist()]):
                n, shapes = len(block.texts), LineShapes(block)
                p = Phrases(block, shapes)
                some = p.rows[p.line[p.at]]
                h, text = _distinct(p.hash[some], p.text[p.at[some]])
                of, counts = np.unique(text, return_counts=True)
                yield {"host": hosts.slice(first, n).take(pa.array(of)), "phrases": list_array(h.view(np.int64), counts, pa.int64())}

        return each

    rows = docs.select(F.coalesce(host_col, F.lit("")).alias("host"), F.col(text_col).alias("_text")).where("_text is not null")
    counted = map_batches(rows, collect, "host string, phrases array<long>").select("host", F.explode("phrases").alias("phrase")).groupBy("phrase", "host").agg(F.count("*").alias("pages"))
    return counted.groupBy("phrase").agg(F.count("*").alias("hosts"), F.sum("pages").alias("pages")).where((F.col("hosts") >= least_hosts) & (F.col("pages") >= least_pages))


def _distinct(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[new], o[new]


def advertising_phrases(docs: DataFrame, text_col: str = "text", host_col: str = "host", ratio: float = 0.5, **floors) -> DataFrame:
    """(phrase): replicated phrases of rows, on at least the share ``ratio`` of all pages that hold them anywhere; see replicated_phrases."""
    replicated = cut(replicated_phrases(docs, text_col, host_col, **floors))
    sent = docs.sparkSession.sparkContext.broadcast(filter_of(replicated, "phrase"))

    class Count:
        """Pages of each phrase; sums are kept for the life of a task up to KEEP phrases."""

        KEEP = 2_000_000

        def __init__(self):
            self.bits = sent.value
            self.phrases, self.pages, self.waiting, self.size = np.zeros(0, _U64), np.zeros(0, np.int64), [], 0

        def __call__(self, batch):
            for _, block in blocks([plain(t) for t in batch.column(0).to_pylist()]):
                p = Phrases(block, LineShapes(block))
                hit = maybe_in(self.bits, p.hash)
                h, _ = _distinct(p.hash[hit], p.text[p.at[hit]])
                self.waiting.append(h)
                self.size += len(h)
                if self.size >= self.KEEP:
                    self.merge()
                    if len(self.phrases) >= self.KEEP:
                        yield from self.out()

        def merge(self):
            h, n = np.unique(np.concatenate(self.waiting), return_counts=True) if self.waiting else (np.zeros(0, _U64), np.zeros(0, np.int64))
            both, which = np.unique(np.concatenate((self.phrases, h)), return_inverse=True)
            self.pages = np.bincount(which, np.concatenate((self.pages, n)), len(both)).astype(np.int64)
            self.phrases, self.waiting, self.size = both, [], 0

        def out(self):
            yield {"phrase": self.phrases.view(np.int64), "anywhere": self.pages}
            self.phrases, self.pages = np.zeros(0, _U64), np.zeros(0, np.int64)

        def finish(self):
            self.merge()
            yield from self.out()

    anywhere = map_batches(docs.select(F.col(text_col).alias("_text")).where("_text is not null"), Count, "phrase long, anywhere long").groupBy("phrase").agg(F.sum("anywhere").alias("anywhere"))
    return replicated.join(anywhere, "phrase").where(F.col("pages") >= ratio * F.col("anywhere")).select("phrase")


def line_kind(line: str, words: int, letters: int, ink: int, runs: int, tokens: int, meet: int, hangul: bool) -> int:
    """What a line of a body is made of, phrases apart. words: those of two letters and more; meet: places where a letter and a digit touch."""
    s = line.strip()
    if ("://" in s or "www." in s) and (link := list(_LINK.finditer(s))):
        rest = s[link[-1].end() :]
        return PROSE if len(_WORD.findall(rest)) >= 4 else LINKS
    if ("#" in s or "tag:" in s) and (len(_TAG.findall(s)) >= 2 or (ink > 12 and _TAG.match(s))):
        return TAGS
    if letters * 10 >= ink * 8 and not meet and (ink >= (7.5 if hangul else 14) * tokens or ("_" in s and sum("_" in t for t in s.split()) * 5 >= tokens)):
        return TAGS  # words run together
    if letters * 10 < ink * 7 or runs < 3 or (letters * 20 < ink * 17 and _CODE.search(s)) or meet * 4 > tokens:
        return JUNK
    ended = s.endswith((".", "!", "?"))
    if runs < 10 and not ended and _BULLET.match(s):
        return JUNK
    if letters > 14 * runs or (letters < 2.2 * runs and not hangul):
        return JUNK
    if ended or s.endswith(("”", '"', "…", ")", "🙂", "❤️", "❤", ":")) or runs >= 8 or (hangul and runs >= 6):
        return PROSE
    return JUNK


def _common_words(common: dict[str, set[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent words, and in which languages they are."""
    words = sorted(set().union(*common.values())) if common else []
    block = Block(words)
    h = block.hashes(block.start[:-1], block.start[1:])
    order = np.argsort(h)
    return h[order], np.array([[w in common[lang] for lang in sorted(common)] for w in words], bool).reshape(len(words), len(common))[order]


_STATISTICS = ("words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "body_chars")
_HITS = {"hit_phrase": pa.int64(), "hit_at": pa.int32(), "hit_line": pa.int32(), "hit_chars": pa.int32(), "hit_words": pa.int32(), "hit_kind": pa.int32()}


def profiles(docs: DataFrame, model: LineModel, phrases: DataFrame, common: dict[str, set[str]], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), salts: int = 8) -> DataFrame:
    """A row for each document whose text is neither null nor blank, with statistics of its body.

    Columns: id, keep, language (that of the frequent words the body has most of; ko where letters mostly
    are Hangul; null without any), words, mean_word_length, symbol_ratio (characters that are neither
    letters, digits nor blanks), punctuated_lines (share of lines that end in punctuation), common_words
    (share of words that are frequent words of that language), body_chars, and the shares of the
    characters in running text (prose), rows of advertising phrases (keywords), links, tags, and anything
    else (other), all over the body; listed is links and tags where the page holds replicated phrases in
    them, else 0. A page without a body is measured by all its lines. The title line is passed over
    unless it is all. A line that describes a link in words is no row. Headings between sentences count for nothing.

    phrases: as advertising_phrases gives them, read more than once.
    """
    columns = [F.col(id_col).alias("_id"), *(F.col(c) for c in keep)]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    phrases = cut(phrases)
    sent = docs.sparkSession.sparkContext.broadcast((model, filter_of(phrases, "phrase"), common))
    kinds = ("c_prose", "c_links", "c_tags", "c_other")

    def make():
        model, bits, common = sent.value
        frequent, languages = _common_words(common)
        names = np.array([*sorted(common), "ko"], object)

        def each(batch):
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            for first, block in blocks([plain(t) for t in texts]):
                shapes = LineShapes(block)
                lines = PageLines(block, True, shapes)
                body = np.zeros(len(shapes.chars), bool)
                body[lines.at[body_mask(model, lines)]] = True
                heading = np.zeros(len(shapes.chars), bool)
                heading[lines.at[lines.between & (lines.long < 4) & ~shapes.ended[lines.at]]] = True
                inked = ~shapes.blank
                # pages without a body: all lines but the title, or the title too if it is all
                for mask in (inked & (np.arange(len(inked)) != shapes.first[shapes.text]), inked):
                    none = np.bincount(shapes.text, body, len(block.texts)) == 0
                    body |= mask & none[shapes.text]
                chosen = np.flatnonzero(body)
                if not len(chosen):
                    continue
                p = Phrases(block, shapes)
                joined = block.joined
                figures = [x[chosen].tolist() for x in (shapes.begin, shapes.end, p.words, shapes.letters, shapes.ink, shapes.runs, shapes.tokens, shapes.meet, shapes.hangul)]
                kind = np.full(len(body), -1)
                kind[chosen] = [line_kind(joined[a:b], *rest) for a, b, *rest in zip(*figures)]
                kind[heading] = -1
                # lines with enough of what may be advertising phrases; for links and tags one is enough
                hit = np.flatnonzero(maybe_in(bits, p.hash) & (kind[p.line[p.at]] >= 0))
                starts = np.zeros(len(p.line), bool)
                starts[p.at[hit]] = True
                share = np.bincount(p.line, starts, len(body))
                listed = (kind == LINKS) | (kind == TAGS)
                likely = ((share >= np.maximum(1, COVERAGE * p.words)) & ~p.address) | (listed & (share > 0))
                hit = hit[likely[p.line[p.at[hit]]]]
                hit = hit[np.argsort(p.text[p.at[hit]], kind="stable")]
                line = p.line[p.at[hit]]

                at, owner = np.unique(shapes.text[chosen], return_inverse=True)
                n = len(at)
                of = lambda x: np.bincount(owner, x[chosen], n)
                letters, digits, ink, runs = of(shapes.letters), of(shapes.digits), np.maximum(1, of(shapes.ink)), of(shapes.runs)
                hangul = of(shapes.letters * shapes.hangul) * 2 > letters
                best, which = np.zeros(n), np.full(n, -1)
                if len(p.line) and len(frequent):
                    words = block.runs(LETTER)
                    two = words[1] - words[0] > 1
                    h = block.hashes(words[0][two], words[1][two])
                    where = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                    found = frequent[where] == h
                    each_language = np.stack([of(np.bincount(p.line[found], languages[where[found], k], len(body))) for k in range(languages.shape[1])])
                    best = each_language.max(axis=0)
                    which = np.where(best > 0, each_language.argmax(axis=0), -1)
                which = np.where((which < 0) & hangul, len(names) - 1, which)
                chars = shapes.chars
                table = {
                    "language": [names[k] if k >= 0 else None for k in which.tolist()],
                    **dict(zip(_STATISTICS, (runs, letters / np.maximum(1, runs), (ink - letters - digits) / ink, of(shapes.ended) / np.bincount(owner, minlength=n), best / np.maximum(1, of(p.words)), of(chars)))),
                    **{name: of(chars * (kind == k)) for k, name in enumerate(kinds)},
                }
                per_page = np.bincount(np.searchsorted(at, p.text[p.at[hit]]), minlength=n)
                flat = (p.hash[hit].view(np.int64), p.at[hit], line, chars[line], p.words[line], kind[line])
                table |= {name: list_array(x, per_page, t) for (name, t), x in zip(_HITS.items(), flat)}
                rows = pa.array(at + first)
                yield {batch.schema.names[k]: batch.column(k).take(rows) for k in range(batch.num_columns - 1)} | table

        return each

    ddl = f"{ddl}, language string, " + ", ".join(f"{n} double" for n in (*_STATISTICS, *kinds)) + ", " + ", ".join(f"{n} array<{'long' if t == pa.int64() else 'int'}>" for n, t in _HITS.items())
    measured = cut(map_batches(docs.select(*columns, F.col(text_col).alias("_text")), make, ddl).withColumn("_row", F.monotonically_increasing_id()))
    # the exact join; a phrase of a third of all pages is spread over several tasks
    hits = measured.where(F.size("hit_phrase") > 0).select("_row", F.explode(F.arrays_zip(*_HITS)).alias("x")).select("_row", "x.*").withColumn("_salt", F.pmod(F.col("_row"), F.lit(salts)).cast("int"))
    salted = phrases.select(F.col("phrase").alias("hit_phrase"), F.explode(F.array(*map(F.lit, range(salts)))).alias("_salt"))
    exact = hits.join(salted, ["hit_phrase", "_salt"], "left_semi").groupBy("_row", "hit_line").agg(F.count_distinct("hit_at").alias("starts"), *(F.first(f"hit_{c}").alias(c) for c in ("chars", "words", "kind")))
    listed = F.col("kind").isin(LINKS, TAGS)
    stitched = ~listed & (F.col("starts") >= F.greatest(F.lit(1.0), COVERAGE * F.col("words")))
    by_page = exact.groupBy("_row").agg(
        F.sum(F.when(stitched, F.col("chars")).otherwise(0)).alias("keywords"),
        *(F.sum(F.when(stitched & (F.col("kind") == k), F.col("chars")).otherwise(0)).alias(f"less_{name}") for k, name in ((PROSE, "prose"), (JUNK, "other"))),
        F.max(listed).alias("replicated"),
    )
    out = measured.drop(*_HITS).join(by_page, "_row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    total = F.col("c_prose") + F.col("c_links") + F.col("c_tags") + F.col("c_other")
    share = lambda x: F.when(total > 0, x / total).otherwise(0.0)
    shares = {
        "prose": share(F.col("c_prose") - zero("less_prose")),
        "keywords": share(zero("keywords")),
        "links": share(F.col("c_links")),
        "tags": share(F.col("c_tags")),
        "other": F.when(total > 0, (F.col("c_other") - zero("less_other")) / total).otherwise(1.0),
        "listed": F.when(F.coalesce("replicated", F.lit(False)) | (share(F.col("c_links") + F.col("c_tags")) >= ALONE), share(F.col("c_links") + F.col("c_tags"))).otherwise(0.0),
    }
    return out.select(F.col("_id").alias(id_col), *keep, "language", *_STATISTICS, *(c.alias(name) for name, c in shares.items()))


def spam_pages(profiled: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of profiles whose body is, by characters, at least the share ``least`` rows of advertising phrases, and links and tags beside replicated phrases."""
    return profiled.where(F.col("keywords") + F.col("listed") >= least)
