"""Surrogates for personal data.

Entities are found by patterns (mail addresses, phone numbers, card numbers, network addresses, national numbers,
secrets, titled and known names) and get keyed replacements: a keyed hash of type and entity draws digits for digits,
letters for letters and names for names, so that format, script and gender stay. The same entity gets the same
surrogate everywhere (coreference), whatever the letter case of a mail address or the spacing of a number; a check over all
entities gives those whose surrogates collide with each other, or with an entity of the corpus, a new draw until all are
distinct. From the fourth draw on surrogates grow, so that this ends for any number of entities. Who holds the key can
tell surrogates from chance, so it is the caller's. Names are found after a title or when their given name is listed, and a family
name alone is not led back to a full name.

Only documents with an entity are joined and rewritten; all others pass through without a shuffle. The entity
table is written once, and no list of entities reaches the driver.

Defined results: null texts stay null and empty ones empty, with no entities; rows that repeat id and text get the same
text; very long texts are searched whole; null ids are treated like others; an empty table gives an empty one; all columns of the documents are kept.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstress.llm.common import free_name
from panelstress.session import materialize

#: Attempt from which on surrogates grow.
LONGER = 3

#: Invented or common given names by gender and script, and family names; a draw takes one of the same kind.
GIVEN = {
    ("f", "latin"): "Alice Amelia Anna Beatrice Camille Clara Claire Diana Elena Emma Eva Greta Hannah Helena Ines Irene Julia Laura Lena Lucia Maria Marta Mia Nina Nora Olivia Paula Rosa Sara Sofia Teresa Vera".split(),
    ("m", "latin"): "Adam Albert Alan Andre Anton Bruno Carlos Daniel David Diego Emil Felix Frank Georg Hugo Ivan Jan John Jonas Karl Leo Lucas Luis Marc Martin Oscar Paul Peter Robert Simon Thomas Victor".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Полина София Тамара Юлия".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Иван Кирилл Максим Олег Павел Роман Юрий".split(),
}
FAMILY = {
    "latin": "Adler Becker Bennett Blanc Bruno Calder Castro Dalton Dubois Ellis Fischer Fuentes Garner Girard Hale Herrera Hoffman Jensen Keller Lambert Lorenz Marsh Molina Moreau Navarro Osborne Palmer Prieto Reyes Rousseau Sander Serra Thornton Vidal Wagner Weber Winter Zeller".split(),
    "cyrillic": "Волков Громов Лебедев Морозов Новиков Орлов Павлов Соколов Тихонов Фролов".split(),
}
#: Titles and the gender that they tell.
TITLES = {
    "mr": "m", "herr": "m", "señor": "m", "sr": "m", "monsieur": "m", "mrs": "f", "ms": "f", "miss": "f", "frau": "f",
    "señora": "f", "sra": "f", "madame": "f", "mme": "f", "dr": "", "prof": "", "господин": "m", "госпожа": "f",
}

_UP, _LOW = "A-ZÀ-ÖØ-ÞА-ЯЁ", "a-zß-öø-ÿа-яё"
_NAME = rf"[{_UP}][{_LOW}]+(?:-[{_UP}][{_LOW}]+)?"
_FORMS = [f(t) for t in TITLES for f in (str.capitalize, str.upper)]
_TITLED = "|".join(sorted(set(_FORMS), key=len, reverse=True))
_KNOWN = "|".join(sorted({n for names in GIVEN.values() for n in names}, key=len, reverse=True))

#: Type and pattern, in the order in which they take hold of a place in the text.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("secret", r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b\s*[=:]\s*[\"']?)(?P<secret>[A-Za-z0-9+/_-]{8,}={0,2})"),
    ("email", r"(?P<email>(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,})"),
    ("ip", r"(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"),
    ("iban", r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"),
    ("card", r"(?P<card>(?<![\w.+-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w]|[.-]\d))"),
    ("national", r"(?P<national>(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-]))"),
    ("phone", r"(?P<phone>(?<![\w.+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)\d{3}[ .-]?\d{3,4}(?![\w])|(?<![\w.+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\w])|(?<![\w.+-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w]))"),
    ("name", rf"(?:\b(?:{_TITLED})\b\.? )(?P<name>{_NAME}(?: {_NAME})?)"),
    ("person", rf"(?P<person>\b(?:{_KNOWN}) {_NAME})"),
)
_FIND = re.compile("|".join(f"(?:{p})" for _, p in PATTERNS))
_TITLE = re.compile(rf"({_TITLED})\.? $")
_SIGNS = re.compile(r"[0-9@]")


def _openings() -> ahocorasick.Automaton:
    """What every match for a name begins with, so that most texts need no pattern at all."""
    out = ahocorasick.Automaton()
    for word in {f"{t}{dot} " for t in _FORMS for dot in ("", ".")} | {f"{n} " for names in GIVEN.values() for n in names}:
        out.add_word(word, 1)
    out.make_automaton()
    return out


_OPENINGS = _openings()


def find(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, type (names with gender and script) and entity of everything found, in order."""
    # No match is possible without one of these, which are quick to look for.
    if not (_SIGNS.search(text) or "=" in text or ":" in text or next(_OPENINGS.iter(text), None)):
        return
    for m in _FIND.finditer(text):
        kind = m.lastgroup
        start, end = m.span(kind)
        value = m.group(kind)
        if kind == "ip" and any(int(x) > 255 for x in value.split(".")):
            continue
        if kind in ("name", "person"):
            title = _TITLE.search(text[max(0, start - 12) : start])
            script = "cyrillic" if re.search("[А-Яа-яЁё]", value) else "latin"
            first = value.split(" ")[0]
            gender = TITLES[title.group(1).lower()] if title else ""
            known = [g for (g, s), names in GIVEN.items() if s == script and first in names]
            gender = gender or (known[0] if known else "")
            kind = f"name:{gender}:{script}"
        yield start, end, kind, value


class _Draw:
    """A stream of keyed pseudo-random numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.seed = hmac.new(key, f"{kind}\0{value}\0{attempt}".encode(), hashlib.sha256).digest()
        self.pool, self.block = 0, 0
        self.left = 1

    def below(self, n: int) -> int:
        if self.left < n << 32:
            self.pool = int.from_bytes(hashlib.sha256(self.seed + self.block.to_bytes(4, "big")).digest(), "big")
            self.block, self.left = self.block + 1, 1 << 256
        self.pool, out = divmod(self.pool, n)
        self.left //= n
        return out


def _like(text: str, draw: _Draw) -> str:
    """Digits for digits and letters for letters of the same case; other characters stay."""
    out = []
    for c in text:
        if c.isdigit():
            out.append(str(draw.below(10)))
        elif "a" <= c <= "z":
            out.append(chr(97 + draw.below(26)))
        elif "A" <= c <= "Z":
            out.append(chr(65 + draw.below(26)))
        elif c.isalpha():
            low = "абвгдеклмнопрстуф" if "а" <= c.lower() <= "я" else "abcdefghijklmnopqrstuvwxyz"
            x = low[draw.below(len(low))]
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def _luhn(digits: str) -> bool:
    d = [int(x) for x in digits[::-1]]
    return sum(d[0::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


_SPACED = ("phone", "card", "iban", "national")


def identity(kind: str, value: str) -> str:
    """What all spellings of one entity share: letter case of mail addresses and spacing of numbers do not count."""
    if kind == "email":
        return value.lower()
    if kind in _SPACED:
        head = re.match(r"\+\d{1,3}(?=[ .(-])", value)
        keep = head.end() if head else 0
        return value[:keep] + (" " if keep else "") + re.sub(r"[^0-9A-Za-z+]", "", value[keep:])
    return value


def render(kind: str, value: str, new: str) -> str:
    """A surrogate of an identity in the letter case or spacing of one mention."""
    if kind == "email":
        return "".join(c.upper() if value[i : i + 1].isupper() else c for i, c in enumerate(new))
    if kind in _SPACED:
        signs = iter(c for c in new if c.isalnum())
        return "".join(next(signs, "") if c.isalnum() else c for c in value) + "".join(signs)
    return new


def surrogate(kind: str, value: str, attempt: int, key: bytes) -> str:
    """Replacement of the same type, script, gender and format; another one for every attempt.

    From attempt LONGER on every attempt is one sign longer, so that there is room for any number of entities.
    """
    draw = _Draw(key, kind, value, attempt)
    extra = max(0, attempt - LONGER + 1)
    if kind.startswith("name:"):
        _, gender, script = kind.split(":")
        words = []
        for i, word in enumerate(re.split(r"([ -])", value)):
            if word in (" ", "-"):
                words.append(word)
            elif i == 0 and (" " in value or gender in ("f", "m")) and " " in value:
                pool = GIVEN[gender or "fm"[draw.below(2)], script]
                words.append(pool[draw.below(len(pool))])
            else:
                pool = FAMILY[script]
                words.append(pool[draw.below(len(pool))])
        out = "".join(words)
        # The lists are short: later attempts add syllables, so that there are names for any number of entities.
        tail = ("ов ин ко ев ский" if script == "cyrillic" else "son man ley ton ard").split()
        for _ in range(attempt):
            out += tail[draw.below(len(tail))]
        return out
    if kind == "ip":
        if extra:  # an address of the larger space
            return ":".join(f"{draw.below(1 << 16):x}" for _ in range(8))
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        labels = domain.split(".")
        more = "".join(chr(97 + draw.below(26)) for _ in range(extra))
        return f"{_like(local, draw)}{more}@{'.'.join([_like(x, draw) for x in labels[:-1]] + labels[-1:])}"
    digits = "".join(str(draw.below(10)) for _ in range(extra))
    if kind == "iban":
        return value[:2] + _like(value[2:], draw) + digits
    if kind == "phone":
        head = re.match(r"\+\d{1,3}(?=[ .(-])", value)
        keep = head.end() if head else 0
        return value[:keep] + _like(value[keep:], draw) + digits
    out = _like(value, draw) + digits
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        if _luhn(digits):  # a valid number gets a valid one
            last = max(i for i, c in enumerate(out) if c.isdigit())
            out = next(o for d in "0123456789" if _luhn(re.sub(r"\D", "", o := out[:last] + d + out[last + 1 :])))
    elif kind == "secret" and re.fullmatch(r"[0-9a-f]+", value):
        out = "".join("0123456789abcdef"[draw.below(16)] for _ in range(len(value) + extra))
    return out


def _marked(documents: DataFrame, text_col: str, mark: str) -> DataFrame:
    """The documents with the distinct entities of each text."""
    columns = ", ".join(f"`{c}` {t}" for c, t in documents.dtypes)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "value": v} for k, v in sorted({(k, identity(k, v)) for _, _, k, v in find(t)})] if t else [] for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, mark])

    return documents.mapInArrow(run, f"{columns}, `{mark}` array<struct<kind:string,value:string>>")


def _draws(entities: DataFrame, key: bytes) -> DataFrame:
    """Adds the surrogate of the current attempt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "value", "attempt")), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(*r, key) for r in rows], pa.string())], [*batch.schema.names, "surrogate"])

    return entities.mapInArrow(run, "kind string, value string, attempt int, surrogate string")


def surrogate_table(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, value, attempt, surrogate of distinct (kind, value): distinct surrogates, none an entity of the corpus.

    In every round those whose surrogate is taken draw again: all but the smallest of equal surrogates, and those
    that name an entity. Settled rows keep theirs, and new draws are checked against them.
    """
    entities = materialize(entities.select("kind", "value").distinct(), "entities")
    table = materialize(_draws(entities.withColumn("attempt", F.lit(0)), key), "surrogates")
    real = entities.select(F.col("value").alias("surrogate")).distinct().withColumn("real", F.lit(True))
    while True:  # every attempt beyond the first few multiplies the room, so few rounds follow
        rank = F.struct("attempt", "kind", "value")
        first = table.groupBy("surrogate").agg(F.min(rank).alias("first"))
        checked = table.join(first, "surrogate").join(real, "surrogate", "left").withColumn("again", F.col("real").isNotNull() | (rank != F.col("first")))
        checked = materialize(checked.select("kind", "value", "attempt", "surrogate", "again"), "checked")
        if checked.where("again").isEmpty():
            return checked.drop("again")
        redrawn = _draws(checked.where("again").select("kind", "value", (F.col("attempt") + 1).alias("attempt")), key)
        table = materialize(checked.where("NOT again").drop("again").unionByName(redrawn), "surrogates")


def replace_entities(documents: DataFrame, key: bytes, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The documents with every entity replaced; ``count_col`` adds the number of replacements."""
    mark, names = free_name(documents, "_entities"), free_name(documents, "_mark")
    marked = _marked(documents, text_col, mark)
    plain = marked.where(F.size(mark) == 0).drop(mark)
    # Rows with entities get a key of their content, so that their surrogates can be gathered by it.
    content = F.struct(F.xxhash64(text_col).alias("a"), F.xxhash64(F.lit(5), text_col).alias("b"))
    touched = materialize(marked.where(F.size(mark) > 0).withColumn(names, content), "touched")
    table = surrogate_table(touched.select(F.explode(mark).alias("e")).select("e.*"), key)
    wanted = touched.select(names, F.explode(mark).alias("e")).distinct().select(names, "e.kind", "e.value")
    gathered = wanted.join(table.select("kind", "value", "surrogate"), ["kind", "value"]).groupBy(names).agg(
        F.collect_list(F.struct("kind", "value", "surrogate")).alias("_table")
    )
    joined = touched.drop(mark).join(gathered.hint("shuffle_hash"), names, "left").drop(names)
    counted = f", `{count_col}` bigint" if count_col else ""
    kept = list(documents.columns)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, numbers = [], []
            for text, rows in zip(batch.column(text_col).to_pylist(), batch.column("_table").to_pylist(), strict=True):
                new = {(r["kind"], r["value"]): r["surrogate"] for r in rows}
                out, at, n = [], 0, 0
                for start, end, kind, value in find(text):
                    out += [text[at:start], render(kind, value, new[kind, identity(kind, value)])]
                    at, n = end, n + 1
                texts.append("".join([*out, text[at:]]))
                numbers.append(n)
            data = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(
                data + ([pa.array(numbers, pa.int64())] if count_col else []), kept + ([count_col] if count_col else [])
            )

    columns = ", ".join(f"`{c}` {t}" for c, t in documents.dtypes)
    rewritten = joined.mapInArrow(rewrite, columns + counted)
    return (plain.withColumn(count_col, F.lit(0).cast("long")) if count_col else plain).unionByName(rewritten)
