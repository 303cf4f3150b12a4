"""One form for texts that look the same: confusables skeletons.

The skeleton of a text is its canonical decomposition, with every character replaced by the
prototype of its look and the result decomposed again. Prototypes come from rules over the Unicode
data (width, font, ligature and no-break variants; kinds of blanks; characters that show nothing)
and, for letters of other alphabets with the look of a Latin letter, from the confusables data of the
Unicode Consortium that come with Spark's own libraries (ICU), with a short table beside them. Case, accents,
digits against letters, superscripts and circled forms, the number and place of blanks and line
breaks all show, and are kept. A zero-width joiner between two pictographs changes the picture, and
is kept too.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches
from .checkpoints import cut

# Characters of the same look, and the character that stands for them.
LOOK_ALIKES = {
    "АВЕЅІЈКМНОРСТУХԚԜ": "ABESIJKMHOPCTYXQW",
    "аеорсухѕіјһԛԝԁӏѵ": "aeopcyxsijhqwdlv",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    "ανορϳϲ": "avopjc",
    "ՏՕոսհօց": "SOnuhog",
    "ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ": "ABCDEHJKLMPRSTVWZ",
    "ɑɡĐƉ": "agÐÐ",
    "‐‑": "--",
    "ǃ꞉∶∕⁄∣": "!:://|",
}

#: Compatibility variants that look like what they decompose to.
SAME_LOOK = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}
_LINE_ENDS = "\r\v\f\x1c\x1d\x1e\x85  "
#: Format characters that do show.
_SHOWN = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
_HIDDEN = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
_PICTURE = "←-⯿\U0001f000-\U0001faff"


@functools.cache
def prototypes() -> dict[str, str]:
    """Every character whose prototype is not itself; canonical decomposition is done apart from this."""
    table: dict[str, str] = {}
    for c in [*range(0x20000), *range(0xE0000, 0xE1000)]:
        ch = chr(c)
        kind = unicodedata.category(ch)
        if ch in _LINE_ENDS:
            table[ch] = "\n"
        elif kind == "Zs" or ch == "\t":
            if ch != " ":
                table[ch] = " "
        elif c in _HIDDEN or (kind in ("Cf", "Cc") and c not in _SHOWN and ch != "\n" and c != 0x200D):
            table[ch] = ""
        elif (tag := unicodedata.decomposition(ch)).startswith("<"):
            tag, _, rest = tag.partition(" ")
            if tag in SAME_LOOK and not rest.startswith("0020") and ch != "ſ":
                table[ch] = unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in rest.split()))
    for many, one in LOOK_ALIKES.items():
        table.update(zip(many, one))
    return _closed(table)


def _closed(table: dict[str, str]) -> dict[str, str]:
    """The table with prototypes in place of the characters of its prototypes that have some."""
    out = {}
    for ch, to in table.items():
        while (further := "".join(table.get(x, x) for x in to)) != to:
            to = further
        out[ch] = to
    return out


@functools.cache
def _confusable_letters() -> dict[str, str]:
    """Letters of other alphabets and the Latin letter of their look and case, by ICU's confusables data; none where ICU is not there.

    Of Latin letters that ICU takes for each other (I and l) the one of the same case stands.
    """
    from pyspark import SparkContext

    letters = [chr(c) for c in range(0x100, 0x20000) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Lo") and not unicodedata.name(chr(c), "LATIN").startswith("LATIN")]
    latin = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    try:
        checker = SparkContext._active_spark_context._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        looks = checker.getSkeleton("\n".join([*latin, *letters])).split("\n")
    except (AttributeError, TypeError):
        return {}
    if len(looks) != len(latin) + len(letters):
        return {}
    of: dict[str, list[str]] = {}
    for c, look in zip(latin, looks):
        of.setdefault(look, []).append(c)
    out = {}
    for c, look in zip(letters, looks[len(latin) :]):
        fits = [x for x in of.get(look, ()) if x.isupper() == c.isupper()]
        if fits:
            out[c] = fits[0]
    return out


class Skeletons:
    """Skeletons by the prototypes and further look-alikes."""

    def __init__(self, more: dict[str, str]):
        self.table = _closed(more | prototypes())
        self.pattern = _pattern_of(self.table)

    def __call__(self, text: str) -> str:
        """The form that all texts of the same look share."""
        if text.isascii() and not _PLAIN.search(text):
            return text
        text = text.replace("\r\n", "\n")
        text = self.pattern.sub(lambda m: "".join(map(self.table.__getitem__, m[0])), unicodedata.normalize("NFD", text))
        if "\u200d" in text:
            text = _JOINER.sub("", text)
        return unicodedata.normalize("NFD", text)


@functools.cache
def _skeletons(more: tuple[tuple[str, str], ...] = ()) -> Skeletons:
    return Skeletons(dict(more))


def skeleton(text: str) -> str:
    """The skeleton by the rules and the short table alone."""
    return _skeletons()(text)


def _pattern_of(table: dict[str, str]) -> re.Pattern:
    points = sorted(map(ord, table))
    spans: list[list[int]] = []
    for p in points:
        if spans and p == spans[-1][1] + 1:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]+")


_JOINER = re.compile(f"(?<![{_PICTURE}])‍|‍(?![{_PICTURE}])")
_PLAIN = re.compile("[\x00-\x09\x0b-\x1f\x7f]")


def consistent_form(text: str, of: Skeletons | None = None) -> str:
    """The skeleton, composed: what to store in place of the text."""
    return unicodedata.normalize("NFC", (of or _skeletons())(text))


def _key(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def consistent_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, form) for every row; null stays null, a text that shows nothing becomes what is left of it."""
    kind = docs.schema[id_col].dataType.simpleString()
    more = tuple(_confusable_letters().items())  # some hundred letters

    def make():
        of = _skeletons(more)

        def each(batch):
            yield {"_id": batch.column(0), "form": [None if t is None else consistent_form(t, of) for t in batch.column(1).to_pylist()]}

        return each

    return map_batches(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), make, f"_id {kind}, form string").withColumnRenamed("_id", id_col)


def skeleton_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, look, exact): 128-bit keys of the skeleton and of the text. Rows whose text is null or shows nothing are left out."""
    kind = docs.schema[id_col].dataType.simpleString()
    more = tuple(_confusable_letters().items())

    def make():
        of = _skeletons(more)

        def each(batch):
            forms = [None if t is None or not (s := of(t)).strip() else (_key(s), _key(t)) for t in batch.column(1).to_pylist()]
            some = pa.array([x is not None for x in forms])
            yield {"_id": batch.column(0).filter(some), "look": [x[0] for x in forms if x], "exact": [x[1] for x in forms if x]}

        return each

    return map_batches(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), make, f"_id {kind}, look binary, exact binary").withColumnRenamed("_id", id_col)


def look_alike_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows whose texts differ and look the same.

    Different texts of one look are paired first, each once however many copies it has, and the pairs are
    then joined with the rows that hold their texts: a text that fills a third of the table with equal
    copies costs a row for each pair it is in.
    """
    keys = cut(skeleton_keys(docs, id_col, text_col))
    texts = keys.select("look", "exact").distinct()
    one, two = texts.withColumnRenamed("exact", "exact_a"), texts.withColumnRenamed("exact", "exact_b")
    pairs = one.join(two, "look").where("exact_a < exact_b").select("exact_a", "exact_b")
    rows = keys.select(id_col, "exact")
    both = pairs.join(rows.toDF("_a", "exact_a"), "exact_a").join(rows.toDF("_b", "exact_b"), "exact_b").where("_a <> _b")
    return both.select(F.least("_a", "_b").alias("id_a"), F.greatest("_a", "_b").alias("id_b")).distinct()


def look_alike_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, variants): least id of the rows of the same look, and how many different texts they have."""
    keys = cut(skeleton_keys(docs, id_col, text_col))
    classes = keys.groupBy("look", "exact").agg(F.min(id_col).alias("low")).groupBy("look").agg(F.min("low").alias("class_id"), F.count("*").alias("variants"))
    return keys.join(classes, "look").select(id_col, "class_id", "variants")
