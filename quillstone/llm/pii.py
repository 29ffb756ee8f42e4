"""Personal data in free text: found, and replaced by typed placeholders that hold keyed surrogates.

Finding. E-mail addresses, phone numbers, national identity numbers and street addresses have patterns, checks
(control digits, dates, groupings) and words before them that rule them out (case and invoice numbers).
Names are read in two ways. Two lexicons, of given and of family names, are gathered from all lists of persons in
the corpus, and a record's own list counts besides; a small grammar reads given names, initials and family names in
either order. Names in no list are told by shape and context: two to four capitalised words that are no words of
law or offices, beside a word that goes with persons (an office before, a verb of signing after). A name that a firm
bears is none.

Surrogates. Mentions of one person in a record are one entity: partial names and initials are tied to the
only full name that fits. Each entity gets a surrogate from a keyed hash, of its type: a name of the
same number of parts, in its script, ending like the original (the endings carry what gender the name shows), written in
the case, order and with the initials of the mention; phone numbers by a keyed permutation of all numbers of eight
digits, identity numbers by one into a range that no real person has, so that they can't collide, in the digit groups of
the mention; addresses with the sides, the ending, the digits and the letter, and e-mail addresses with the words of the
mention. Surrogates are checked for collisions over the whole corpus, and those that collide are drawn again until
all entities of a kind differ. The same entity has the same surrogate everywhere under the same key.

One narrow pass finds mentions and draws; rows come back by the record. The lexicons that are broadcast hold the MOST_NAMES
most frequent name parts; further ones, if there are any, are joined to the words of the texts and reach the reader with
the record, so that the bound changes no row.

Defined cases: null and empty texts have no mentions and stay as they are; a null or empty list of persons adds
nothing; texts of any length are read whole; rows repeated with one record_id give each mention once;
positions are code points of the raw text, also where it is decomposed; empty tables give empty ones;
other columns aren't read.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Collection, Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.privacy import LEGAL_WORDS
from ..operators.skew import lookup_join
from ..session import cut

MOST_NAMES = 500_000
FIELDS = ("signature_text", "procuration_text")
KINDS = ("name", "email", "phone", "id", "address")

#: Last parts of street names, words that follow a street's own name, and tails of firms' names (fixed values).
STREET_ENDINGS = "gata gaten gate vegen veien veg vei stien sti tunet lia kroken svingen bakken haugen havna torget plassen bryggen brygga ringen jordet åsen alléen alleen".split()
STREET_SIDES = "Nordre Søndre Østre Vestre Øvre Nedre Indre Ytre Midtre Gamle Nye Store Lille".split()
STREET_WORDS = "plass allé alle brygge gate vei veg torg terrasse ring".split()
FIRM_TAILS = "AS ASA ANS DA SA KS BA NUF ENK STI BRL SF GmbH ApS KG OG AG Holding Invest Drift Eiendom Gruppen".split()
#: Shortened last parts of street names, and words of the same ending that are none (fixed values).
STREET_SHORT = ["gt", "gt.", "vn.", "v.", "pl."]
NO_STREETS = ["solgt", "valgt", "lagt", "sagt", "langt", "bragt", "utvalgt", "tillagt", "fastlagt", "vedlagt", "pålagt", "forlangt", "oppsagt"]
#: Words that go with persons, before or after a name (fixed values).
BEFORE_NAMES = ["leder", "styreleder", "nestleder", "medlem", "styremedlem", "varamedlem", "direktør", "prokurist", "prokuristen", "innehaver", "komplementar", "deltaker", "fullmektig", "eier", "kasserer", "sekretær", "formann", "signatar", "ved", "herr", "fru", "navn", "kontaktperson", "underskriften", "til", "av", "eg", "jeg", "og", "eller", "samt"]
AFTER_NAMES = ["kan", "alene", "åleine", "har", "signerer", "underskriver", "undertegner", "tegner", "forplikter", "binder", "er", "i", "sammen", "saman", "hver", "kvar", "og", "eller", "født", "skriver", "representerer", "bosatt", "møter"]
#: Words that are no parts of names, though capitalised at the start of a sentence or in titles (fixed values).
NO_NAMES = ["adressen", "arkivet", "avdeling", "bare", "den", "det", "dette", "etter", "foretaket", "fullmakt", "fullmakten", "fullmektigen", "fødselsnr", "faktura", "hos", "id", "kopi", "kontaktperson", "konto", "leder", "leverandør", "når", "navn", "ny", "omsetningen", "oppgjør", "originalen", "post", "prokura", "referanse", "saken", "se", "selskapet", "signatur", "skjema", "skriv", "sms", "sted", "styret", "styrets", "telefon", "tlf", "underskriften", "ved", "vedtak", "vedtektene", "vår", "for", "eg", "jeg"]
#: Words after which a number is no phone number (fixed values).
NO_PHONE = "vedtak referanse ref nummer nr sak saken som og faktura konto skjema organisasjonsnummer orgnr gnr bnr".split()

_EMAIL = re.compile(r"(?<![\w.+\-])[^\W]+(?:[.+\-%][\w]+)*(?: ?@ ?| ?\(at\) ?| ?\[at\] ?)\w[\w\-]*(?:\.\w[\w\-]*)*\.[^\W\d_]{2,}(?![\w])", re.I)
_ID = re.compile(r"(?<!\d)(?<!\d[.,/\-])\d{2}[.\s\-/]?\d{2}[.\s\-/]?\d{2}[.\s\-/]{0,2}\d{3}[.\s\-/]?\d{2}(?!\d)(?![.,/\-]\d)")
_CODED = re.compile(r"(?<![\d+])(?:\(\s?(?:\+|00)\s?47\s?\)|(?:\+|00)47)[\s\-.]?\d(?:[\s.\-]?\d){7}(?!\d)(?![\-/]\d)")
_PHONE = re.compile(r"(?<![\w+])(?<![\d][.,/\-])(?:\d{8}|\d{2}([ \xa0.\-])\d{2}\1\d{2}\1\d{2}|\d{3}([ \xa0.\-])\d{2}\2\d{3}|\d{4}[ \xa0.\-]\d{4})(?!\w)(?![.,/\-]\d)")
_BEFORE = re.compile(r"([^\W\d_]+)[^\w(+]*$")
_HOUSE = re.compile(r"(?<!\w)([^\W\d_](?:[\w'\-]|[̀-ͯ])*+\.?)\s+(?:nr\.?\s*)?\d{1,4}(?:[A-Za-z](?!\w)|\s[A-Za-h](?!\w))?(?!\w)(?![./\-]\d)")
_SIDE = re.compile(rf"(?<![\w])(?:{'|'.join(STREET_SIDES)})\s+$")
_OWN_NAME = re.compile(r"(?<![\w])[A-ZÆØÅÖÄ][^\W\d_\s̀-ͯ]*(?:[\-̀-ͯ]\w+)*\s+$")
_TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")
_FIRM = re.compile(rf"\s+(?:[A-ZÆØÅÖÄ][\w]+\s+)?(?:{'|'.join(FIRM_TAILS)})(?![\w])")


@lru_cache(100_000)
def name_key(token: str) -> str:
    """Comparison form of a part of a name: composed, folded, without acute accents."""
    t = token if token.isascii() else unicodedata.normalize("NFC", token)
    return t.casefold().translate(_ACUTE)


_ACUTE = str.maketrans("áéíóúý", "aeiouy")


@lru_cache(100_000)
def parts_of(name: str | None) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Given and family parts of a listed name, written as given names, then one family name, or with a comma."""
    if not name:
        return (), ()
    if "," in name:
        last, _, rest = name.partition(",")
        name = f"{rest} {last}"
    tokens = tuple(k for k in map(name_key, _TOKEN.findall(name)) if len(k) > 1)
    return tokens[:-1], tokens[-1:]


def valid_id(digits: str) -> bool:
    """Eleven digits with a possible date (days up by 40, months up by 40 or 80 allowed) and both control digits right."""
    d = [int(c) for c in digits]
    day, month = d[0] * 10 + d[1], d[2] * 10 + d[3]
    if not (1 <= day <= 31 or 41 <= day <= 71) or not (1 <= month % 40 <= 12 and month < 93):
        return False
    return all(sum(a * b for a, b in zip(d, w)) % 11 == 0 for w in ((3, 7, 6, 1, 8, 9, 4, 5, 2, 1), (5, 4, 3, 2, 7, 6, 5, 4, 3, 2, 1)))


_DIGIT, _MANY_DIGITS = re.compile(r"\d"), re.compile(r"(?:\d[^\w\n]{0,3}){8}|\d{8}")
_ENDINGS, _SHORT = tuple(STREET_ENDINGS), tuple(STREET_SHORT)


def _free(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    return all(b <= x or a >= y for x, y in taken)


class Classes(dict):
    """Class of a token, worked out once: given (G), family (F) or neither (''), and letters of a genitive ending."""

    def __init__(self, given: set[str], family: set[str], most: int = 300_000) -> None:
        super().__init__()
        self.given, self.family, self.most = given, family, most

    def __missing__(self, token: str) -> tuple[str, int]:
        if len(self) > self.most:
            self.clear()
        self[token] = out = self.of(token, (), ())
        return out

    def of(self, token: str, given: Collection[str], family: Collection[str]) -> tuple[str, int]:
        """The class with further names."""
        if len(token) == 1:
            return "I", 0
        k = name_key(token)
        for cut_ in (0, 1) if k.endswith("s") and len(k) > 3 else (0,):
            base = k[: len(k) - cut_]
            if base in self.family or base in family:
                return "F", cut_
            if base in self.given or base in given:
                return "G", cut_
        return "", 0


_INITIAL_GAP, _GIVEN_GAP, _ORDER_GAP = re.compile(r"\.\s{0,2}|\.-"), re.compile(r"\s{1,3}|-"), re.compile(r",\s{1,3}|\s{1,3}")
_NUMBERED = re.compile(r"[\d§]\s*$")
_WORD_BEFORE, _WORD_AFTER = re.compile(r"([^\W\d_]+)[\s:,–\-]{1,4}$"), re.compile(r"[\s,–]{0,3}([^\W\d_]+)")
_SHAPE = re.compile(r"(?<![\w@.\-])[A-ZÆØÅÖÄ][a-zæøåöäéèüñ]+(?:-[A-ZÆØÅÖÄ][a-zæøåöäéèüñ]+)?(?: (?:[A-ZÆØÅÖÄ]\. )?[A-ZÆØÅÖÄ][a-zæøåöäéèüñ]+(?:-[A-ZÆØÅÖÄ][a-zæøåöäéèüñ]+)?){1,3}(?![\w@\-])")
_PLAIN_WORDS = frozenset(LEGAL_WORDS["NO"]) | frozenset(NO_NAMES) | frozenset(BEFORE_NAMES) | frozenset(STREET_WORDS) | frozenset(s.casefold() for s in STREET_SIDES)
_BEFORE_NAMES, _AFTER_NAMES, _FIRM_WORDS = frozenset(BEFORE_NAMES), frozenset(AFTER_NAMES), frozenset(FIRM_TAILS)


class Reader:
    """Finds mentions in texts of one record at a time."""

    def __init__(self, given: set[str], family: set[str]) -> None:
        self.given, self.family = given, family
        self.classes = Classes(given, family)

    def names(self, text: str, taken: list[tuple[int, int]], given: set[str], family: set[str]) -> list[tuple[int, int]]:
        classes = self.classes
        if given or family:
            classes = {t: self.classes.of(t, given, family) for t in set(_TOKEN.findall(text))}
        tokens = []  # parts of names alone: any word between two of them keeps them apart
        for m in _TOKEN.finditer(text):
            kind, gen = classes[m.group()]
            if not kind or not _free(taken, m.start(), m.end()):
                continue
            if kind == "I" and (text[m.end() : m.end() + 1] != "." or _NUMBERED.search(text, max(0, m.start() - 3), m.start()) or not m.group().isalpha()):
                continue
            tokens.append((m.start(), m.end(), kind, gen))
        if not any(t[2] != "I" for t in tokens):
            return []

        def gap(i: int) -> str:
            return text[tokens[i][1] : tokens[i + 1][0]] if i + 1 < len(tokens) else "\0"

        def joined(i: int) -> bool:
            """Whether token i and the next may be parts of one name, as to what stands between."""
            g = gap(i)
            if tokens[i][3]:
                return False
            if tokens[i][2] == "I":
                return _INITIAL_GAP.fullmatch(g) is not None
            return _GIVEN_GAP.fullmatch(g) is not None

        def given_run(i: int) -> int:
            """Last token of the run of given names and initials that begins with i."""
            while i + 1 < len(tokens) and joined(i) and tokens[i + 1][2] in ("G", "I"):
                i += 1
            return i

        out, i = [], 0
        while i < len(tokens):
            kind = tokens[i][2]
            end = -1
            if kind in ("G", "I"):
                j = given_run(i)
                if j + 1 < len(tokens) and tokens[j + 1][2] == "F" and joined(j):
                    end = j + 1
                    if not tokens[end][3] and gap(end) == "-" and tokens[end + 1][2] == "F":
                        end += 1
                elif any(tokens[k][2] == "G" for k in range(i, j + 1)):
                    while tokens[i][2] == "I":
                        i += 1
                    end = j
            elif kind == "F":
                end = i
                if not tokens[i][3] and i + 1 < len(tokens) and tokens[i + 1][2] in ("G", "I") and _ORDER_GAP.fullmatch(gap(i)):
                    j = given_run(i + 1)
                    own = j + 1 < len(tokens) and tokens[j + 1][2] == "F" and joined(j)
                    if not own:
                        end = j
            if end >= 0:
                a, b = tokens[i][0], tokens[end][1] - tokens[end][3]
                if tokens[end][2] == "I":
                    b += 1  # the stop of a last initial belongs to the name
                if not _FIRM.match(text, b):
                    out.append((a, b))
                i = end + 1
            else:
                i += 1
        return out

    def unlisted(self, text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Names in no lexicon, by their shape and the words around them."""
        out = []
        for m in _SHAPE.finditer(text):
            a, b = m.start(), m.end()
            words = [(t.start(), t.end()) for t in _TOKEN.finditer(text, a, b)]
            opener = ""
            while words and name_key(text[slice(*words[0])]) in _PLAIN_WORDS:
                opener = text[slice(*words[0])].casefold()
                words = words[1:]
            if len([1 for x, y in words if y - x > 1]) < 2 or any(name_key(text[x:y]) in _PLAIN_WORDS or text[x:y] in _FIRM_WORDS for x, y in words):
                continue
            a = words[0][0]
            after = _WORD_AFTER.match(text, m.end())
            if text[b - 1] == "s" and after and after[1].islower() and after[1] not in _AFTER_NAMES:
                b -= 1  # a genitive
            if _FIRM.match(text, m.end()) or not _free(taken, a, b):
                continue
            before = _WORD_BEFORE.search(text[max(0, a - 30) : a])
            office = opener or (before[1].casefold() if before else "")
            said = after[1] if after else ""
            if (office in _BEFORE_NAMES and (office not in ("og", "eller", "samt", "til", "av", "ved") or said in _AFTER_NAMES)) or (said in _AFTER_NAMES and said != "i" and office not in ("i", "på", "fra", "over", "om", "for", "hos")):
                out.append((a, b))
        return out

    def addresses(self, text: str) -> Iterator[tuple[int, int]]:
        """Streets with a house number: from the number back to the street's name and its side."""
        for m in _HOUSE.finditer(text):
            word, a = m.group(1), m.start()
            low = word.casefold()
            if low in STREET_WORDS or low in _ENDINGS:
                own = _OWN_NAME.search(text, max(0, a - 200), a) if low in STREET_WORDS else None
                if not own:
                    continue
                a = own.start()
            elif not low.endswith(_ENDINGS) and not (low.endswith(_SHORT) and word[0].isupper() and len(word) > 4 and low not in NO_STREETS):
                continue
            if side := _SIDE.search(text, max(0, a - 200), a):
                a = side.start()
            yield a, m.end()

    def read(self, text: str | None, persons: list[str] | None, more: Iterable[tuple[str, str]] = ()) -> list[tuple[str, int, int]]:
        """(kind, start, end) of all mentions of a text; `more`: further parts of names with their class, G or F."""
        if not text:
            return []
        found: list[tuple[str, int, int]] = []
        taken: list[tuple[int, int]] = []

        def take(kind: str, a: int, b: int) -> None:
            if _free(taken, a, b):
                found.append((kind, a, b))
                taken.append((a, b))

        if "@" in text or "at)" in (low := text.lower()) or "at]" in low:
            for m in _EMAIL.finditer(text):
                take("email", m.start(), m.end())
        if _DIGIT.search(text):
            if _MANY_DIGITS.search(text):
                for m in _ID.finditer(text):
                    if valid_id(re.sub(r"\D", "", m.group())):
                        take("id", m.start(), m.end())
                for m in _CODED.finditer(text):
                    take("phone", m.start(), m.end())
                for m in _PHONE.finditer(text):
                    word = _BEFORE.search(text[max(0, m.start() - 40) : m.start()])
                    if not word or word.group(1).casefold() not in NO_PHONE:
                        take("phone", m.start(), m.end())
            for a, b in self.addresses(text):
                take("address", a, b)
        given, family = {k for k, c in more if c == "G"}, {k for k, c in more if c == "F"}
        for p in persons or ():
            g, f = parts_of(p)
            given.update(x for x in g if x not in self.given)
            family.update(x for x in f if x not in self.family)
        for a, b in self.names(text, taken, given, family):
            take("name", a, b)
        for a, b in self.unlisted(text, taken):
            take("name", a, b)
        return sorted(found, key=lambda x: (x[1], x[2]))

    def entity(self, mention: str, persons: list[tuple[tuple[str, ...], str]], more: Collection[str] = ()) -> str:
        """Canonical person of a name: given names, then family name; a partial name takes the only full one that fits."""
        keys = [name_key(t) for t in _TOKEN.findall(mention)]
        family = [k for k in keys if k in self.family or k in more or any(k == f for _, f in persons)]
        given = [k for k in keys if k not in family]
        fits = [
            (g, f)
            for g, f in persons
            if (not family or f in family) and all(any(x == k or (len(k) == 1 and x.startswith(k)) for x in g) for k in given)
        ]
        if len(set(fits)) == 1:
            return " ".join((*fits[0][0], fits[0][1]))
        return " ".join((*given, *family))


_ROW = pa.schema([("record_id", pa.int64()), ("field_name", pa.string()), ("kind", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("mention", pa.string()), ("entity", pa.string()), ("surrogate", pa.string())])
_ROW_SCHEMA = "record_id bigint, field_name string, kind string, start_pos int, end_pos int, mention string, entity string, surrogate string"


def lexicon(records: DataFrame) -> DataFrame:
    """(name, kind, n) of all parts of the names in all lists of persons: kind is G or F, whichever is more frequent."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, kinds = [], []
            for p in b.column(0).to_pylist():
                g, f = parts_of(p)
                names += g + f
                kinds += ["G"] * len(g) + ["F"] * len(f)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(kinds, pa.string())], names=["name", "kind"])

    listed = records.select(F.explode("person_names").alias("p")).where("p is not null").distinct()
    counts = listed.mapInArrow(scan, "name string, kind string").groupBy("name").agg(F.count_if(F.col("kind") == "G").alias("g"), F.count_if(F.col("kind") == "F").alias("f"))
    return counts.select("name", F.when(F.col("g") >= F.col("f"), "G").otherwise("F").alias("kind"), (F.col("g") + F.col("f")).alias("n"))


def _rest(records: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """(record_id, more): the parts of names beyond the `most` most frequent ones that stand in the texts of a record."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = [], []
            for record, *texts in zip(*(c.to_pylist() for c in b.columns)):
                found = {name_key(t) for text in texts for t in _TOKEN.findall(text or "") if len(t) > 1}
                found |= {k[:-1] for k in found if k.endswith("s") and len(k) > 3}
                ids += [record] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string())], names=["record_id", "name"])

    words = cut(records.select("record_id", *FIELDS).mapInArrow(scan, "record_id bigint, name string"))
    first = names.orderBy(F.desc("n"), "name").limit(most).select("name")
    known = names.join(first, "name", "left_anti").select("name", "kind").join(words.groupBy("name").agg(F.count("*").alias("n")), "name")
    return lookup_join(words, cut(known), "name", "n", "kind").groupBy("record_id").agg(F.collect_set(F.struct("name", "kind")).alias("more"))


def mentions(records: DataFrame, key: str = "", most_names: int | None = None) -> DataFrame:
    """(record_id, field_name, kind, start_pos, end_pos, mention, entity, surrogate) of all mentions in FIELDS."""
    most = MOST_NAMES if most_names is None else most_names
    names = cut(lexicon(records))
    top = names.orderBy(F.desc("n"), "name").limit(most).select("name", "kind").collect()
    sent = records.sparkSession.sparkContext.broadcast(({r["name"] for r in top if r["kind"] == "G"}, {r["name"] for r in top if r["kind"] == "F"}))
    slim = records.select(F.col("record_id").cast("bigint").alias("record_id"), "person_names", *FIELDS).where("record_id is not null and (signature_text is not null or procuration_text is not null)")
    if len(top) == most and names.count() > most:
        slim = slim.join(_rest(slim, names, most), "record_id", "left")
    else:
        slim = slim.withColumn("more", F.lit(None).cast("array<struct<name:string,kind:string>>"))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, drawn = Reader(*sent.value), {}
        for b in batches:
            rows = []
            for record, persons, first, second, more in zip(*(c.to_pylist() for c in b.columns)):
                more = [(m["name"], m["kind"]) for m in more or ()]
                families = {n for n, k in more if k == "F"}
                found = [(field, text, m) for field, text in zip(FIELDS, (first, second)) if text for m in reader.read(text, persons, more)]
                if not found:
                    continue
                known = []
                if any(m[0] == "name" for _, _, m in found):
                    known = {(tuple(g), f[0]) for g, f in map(parts_of, persons or ()) if f and g}
                    known = sorted(known | {(tuple(k[:-1]), k[-1]) for _, t, (kind, a, e) in found if kind == "name" for k in [_full(t[a:e], reader, families)] if k})
                for field, text, (kind, a, e) in found:
                    said = text[a:e]
                    who = (kind, reader.entity(said, known, families) if kind == "name" else _plain(kind, said))
                    if who not in drawn:
                        if len(drawn) > 200_000:
                            drawn.clear()
                        drawn[who] = draw(key, *who, 0)
                    rows.append((record, field, kind, a, e, said, who[1], drawn[who]))
            cols = list(zip(*rows)) if rows else [()] * len(_ROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ROW)], schema=_ROW)

    slim = slim.select("record_id", "person_names", *FIELDS, "more")
    return settled(cut(slim.mapInArrow(scan, _ROW_SCHEMA).distinct()), key)


def _full(mention: str, reader: Reader, more: Collection[str]) -> list[str]:
    """Parts of a mention that is a full name, given names first; else empty."""
    keys = [name_key(t) for t in _TOKEN.findall(mention)]
    family = [k for k in keys if k in reader.family or k in more]
    given = [k for k in keys if k not in family and len(k) > 1]
    return [*given, family[0]] if len(family) == 1 and given and len(given) + 1 == len(keys) else []


def _plain(kind: str, mention: str) -> str:
    """Canonical form of a mention that is no name."""
    if kind in ("phone", "id"):
        return re.sub(r"\D", "", mention)[-8 if kind == "phone" else -11 :]
    folded = unicodedata.normalize("NFC", mention).casefold()
    if kind == "email":
        return re.sub(r"\s*(?:@|\(at\)|\[at\])\s*", "@", folded)
    return re.sub(r"\s+", " ", re.sub(r"(\d)\s+(?=\D$)", r"\1", folded))


#: Sounds of surrogate names by script: beginnings, vowels, ends (fixed values).
_SOUNDS = {
    "LATIN": (["b", "br", "d", "dr", "f", "fl", "g", "h", "j", "k", "kl", "l", "m", "n", "p", "r", "s", "sk", "sl", "st", "t", "tr", "v"], ["a", "e", "i", "o", "u", "ø", "å"], ["l", "n", "r", "s", "m", "nd", "rk"]),
    "CYRILLIC": (["б", "в", "г", "д", "ж", "з", "к", "л", "м", "н", "п", "р", "с", "т", "ф", "х"], ["а", "е", "и", "о", "у", "я"], ["в", "н", "р", "к", "ч", "й"]),
    "GREEK": (["β", "γ", "δ", "ζ", "θ", "κ", "λ", "μ", "ν", "π", "ρ", "σ", "τ", "φ", "χ"], ["α", "ε", "η", "ι", "ο", "ω"], ["ς", "ν", "ρ", "ξ"]),
}


def _script(word: str) -> str:
    found = unicodedata.name(word[0], "LATIN").split(" ")[0] if word else "LATIN"
    return found if found in _SOUNDS else "LATIN"


def permuted(n: int, size: int, key: str) -> int:
    """Where a keyed permutation of the numbers below `size` takes n: a Feistel network, walked on until it is in range."""
    half = ((size - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    while True:
        left, right = n >> half, n & mask
        for turn in range(6):
            mixed = hashlib.blake2b(f"{turn}|{right}".encode(), digest_size=8, key=key.encode()[:64]).digest()
            left, right = right, left ^ (int.from_bytes(mixed, "big") & mask)
        n = left << half | right
        if n < size:
            return n


def draw(key: str, kind: str, entity: str, attempt: int) -> str:
    """The surrogate of an entity: for names, streets and mail its words, for numbers its digits."""
    if kind == "phone" and attempt == 0 and len(entity) == 8:
        return f"{permuted(int(entity), 10**8, key):08d}"
    if kind == "id" and attempt == 0 and len(entity) == 11:
        # Day, month, year and serial, without what they are raised by and without control digits, number what can occur.
        day, month, rest = int(entity[:2]), int(entity[2:4]), int(entity[4:9])
        n = permuted((day % 72 * 100 + month) * 10**5 + rest, 28 * 12 * 10**7, key)
        return f"{1 + n % 28:02d}{81 + n // 28 % 12:02d}{n // 336:07d}"
    seed = hmac.new(key.encode(), f"{kind}|{entity}|{attempt}".encode(), hashlib.sha512).digest()
    n = int.from_bytes(seed, "big")

    def pick(options: list[str]) -> str:
        nonlocal n
        n, k = divmod(n, len(options))
        return options[k]

    def word(like: str, syllables: int) -> str:
        onsets, vowels, codas = _SOUNDS[_script(like)]
        body = "".join(pick(onsets) + pick(vowels) for _ in range(syllables))
        return body + (like[-1:] if like[-1:] in vowels else pick(codas))

    if kind == "name":
        parts = entity.split(" ")
        return " ".join(word(p, 3 if i < len(parts) - 1 else 4) for i, p in enumerate(parts))
    if kind in ("phone", "id"):
        return f"{n % 10**8:08d}" if kind == "phone" else f"{1 + n % 28:02d}{81 + n // 28 % 12:02d}{n // 336 % 10**7:07d}"
    if kind == "email":
        local = re.split(r"[^\w]+", entity.partition("@")[0])
        return ".".join(word(p, 5 if len(local) == 1 else 3) for p in local if p) or word("", 5)
    street, _, number = entity.rpartition(" ")
    tail = next((t for t in sorted(_ENDINGS + _SHORT, key=len, reverse=True) if street.endswith(t)), "vegen")
    digits, letter = re.match(r"\D*(\d*)(.*)$", number).groups()
    house = str(10 ** (len(digits) - 1) + n % (9 * 10 ** (len(digits) - 1))) if digits else "1"
    n //= 10**4
    name = word("", 3)
    return f"{name}{tail} {house}{pick(list('abcdefgh')) if letter.strip() else ''}"


def settled(found: DataFrame, key: str) -> DataFrame:
    """`found` (kind, entity, surrogate and others) with surrogates that differ between the entities of a kind.

    Entities whose surrogate another one has, but for the first of them, draw again until all differ."""

    @F.pandas_udf("string")
    def again(kind: pd.Series, entity: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([draw(key, k, e, int(a)) for k, e, a in zip(kind, entity, attempt)], dtype=object)

    clash = [F.min("entity").alias("_first"), F.max("entity").alias("_last")]
    firsts = cut(found.groupBy("kind", "surrogate").agg(*clash).where("_first < _last").select("kind", "surrogate", "_first"))
    if firsts.isEmpty():
        return found
    now = cut(found.select("kind", "entity", "surrogate").distinct())
    for attempt in range(1, 1_000):
        moved = F.col("_first").isNotNull() & (F.col("_first") != F.col("entity"))
        drawn = now.join(firsts, ["kind", "surrogate"], "left").withColumn("_new", again("kind", "entity", F.lit(attempt)))
        now = cut(drawn.select("kind", "entity", F.when(moved, F.col("_new")).otherwise(F.col("surrogate")).alias("surrogate")))
        firsts = cut(now.groupBy("kind", "surrogate").agg(*clash).where("_first < _last").select("kind", "surrogate", "_first"))
        if firsts.isEmpty():
            others = [c for c in found.columns if c != "surrogate"]
            counts = found.groupBy("kind", "entity").agg(F.count("*").alias("_n")).join(now, ["kind", "entity"])
            keyed = counts.select(F.md5(F.concat_ws("|", "kind", "entity")).alias("_ke"), "_n", "surrogate")
            out = lookup_join(found.drop("surrogate").withColumn("_ke", F.md5(F.concat_ws("|", "kind", "entity"))), cut(keyed), "_ke", "_n", "surrogate")
            return out.select(*others, "surrogate")
    raise RuntimeError("surrogates still collide: a kind has more entities than surrogates")


_SIDES_AT = re.compile(rf"(?:{'|'.join(STREET_SIDES)})\s+(?=[^\W\d_])")


def written(kind: str, mention: str, entity: str, surrogate: str) -> str:
    """A surrogate in the writing of a mention, inside its typed placeholder."""
    if kind == "name":
        said, want = [name_key(t) for t in _TOKEN.findall(mention)], dict(zip(entity.split(" "), surrogate.split(" ")))
        out = mention
        for token, k in list(zip(_TOKEN.findall(mention), said))[::-1]:
            new = want.get(k) or next((w[:1] for e, w in want.items() if len(k) == 1 and e.startswith(k)), "x")
            new = new[: 1 if len(token) == 1 else None]
            new = new.upper() if token.isupper() else new.capitalize() if token[:1].isupper() else new
            at = out.rfind(token)
            out = out[:at] + new + out[at + len(token) :] if at >= 0 else out
    elif kind in ("phone", "id"):
        digits, spare = iter(surrogate), len(re.sub(r"\D", "", mention)) - len(surrogate)
        out = ""
        for c in mention:
            if c.isdigit() and spare > 0:
                out, spare = out + c, spare - 1
            else:
                out += next(digits, c) if c.isdigit() else c
    elif kind == "email":
        sign = re.search(r"\s?(?:@|\(at\)|\[at\])\s?", mention, re.I)
        marks = re.findall(r"[.+\-%_]+", mention[: sign.start()] if sign else "")
        local = surrogate.split(".")
        out = "".join(w + m for w, m in zip(local, [*marks[: len(local) - 1], *["."] * len(local)])).rstrip(".+-%_")
        out += (sign.group() if sign else "@") + "mail.invalid"
        out = out.upper() if mention.isupper() else out
    else:
        side = _SIDES_AT.match(mention)
        street, _, number = surrogate.rpartition(" ")
        said = re.search(r"(\s+(?:nr\.?\s*)?)\d+(\s?)([A-Za-z]?)$", mention)
        own = street.capitalize() if mention[side.end() if side else 0 :][:1].isupper() else street
        number = re.sub(r"(\d)([a-z])$", lambda m: m[1] + (said[2] if said else "") + (m[2].upper() if said and said[3].isupper() else m[2]), number)
        out = (side.group() if side else "") + own + (said[1] if said else " ") + number
        out = out.upper() if mention.isupper() else out
    return f"[{kind.upper()}:{out}]"


def masked(records: DataFrame, key: str) -> DataFrame:
    """(record_id, signature_text, procuration_text, n_mentions) with every mention replaced."""
    full = mentions(records, key)
    per = full.groupBy("record_id").agg(F.collect_list(F.struct("field_name", "start_pos", "end_pos", "kind", "mention", "entity", "surrogate")).alias("ms"))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for record, first, second, ms in zip(*(c.to_pylist() for c in b.columns)):
                texts = dict(zip(FIELDS, (first, second)))
                for m in sorted(ms or (), key=lambda m: -m["start_pos"]):
                    t = texts[m["field_name"]]
                    new = written(m["kind"], m["mention"], m["entity"], m["surrogate"])
                    texts[m["field_name"]] = t[: m["start_pos"]] + new + t[m["end_pos"] :]
                for c, v in zip(out, (record, texts[FIELDS[0]], texts[FIELDS[1]], len(ms or ()))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int32())], names=["record_id", *FIELDS, "n_mentions"])

    rows = records.select(F.col("record_id").cast("bigint").alias("record_id"), *FIELDS).where("record_id is not null").dropDuplicates(["record_id"])
    return rows.join(per, "record_id", "left").select("record_id", *FIELDS, "ms").mapInArrow(scan, "record_id bigint, signature_text string, procuration_text string, n_mentions int")
