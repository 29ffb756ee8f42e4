"""Personal identifiers in free text and in keys, with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the control digits of eleven-digit identity numbers (fixed values).
NO_WEIGHTS = ([3, 7, 6, 1, 8, 9, 4, 5, 2], [5, 4, 3, 2, 7, 6, 5, 4, 3, 2])
EE_WEIGHTS = ([1, 2, 3, 4, 5, 6, 7, 8, 9, 1], [3, 4, 5, 6, 7, 8, 9, 1, 2, 3])
#: Words before a birth date or year, as they are written (fixed values).
BIRTH_MARKS = [
    "sünniaeg", "sünnikuupäev", "sündinud", "sünd.", "s.", "født", "f.", "fødselsdato",
    "geb.", "geboren", "born", "d.o.b.", "jahrgang",
]
#: Keys of personal identifiers, in their ascii form (fixed values).
PERSONAL_KEYS = [
    "fodselsnummer", "fodselsdato", "foedselsnummer", "foedselsdato", "personnummer", "dnummer", "cpr", "cprnummer", "foedselsdag", "geburtsdatum",
    "geburtsdaten", "svnr", "sozialversicherungsnummer", "isikukood", "synniaeg", "sunniaeg", "sunnikuupaev", "isikukoodhash", "fyysiliseisikukood",
    "fyysiliseisikusynniaeg", "osaomanikusynniaeg", "birthdate", "dateofbirth", "dob", "nationalid", "personalidentificationnumber", "ssn",
]

#: Words of law and offices that are no names though capitalised, by jurisdiction (fixed values).
LEGAL_WORDS = {
    "NO": [
        "daglig", "leder", "lederen", "styrets", "styret", "styre", "styreleder", "styrelederen", "styremedlem", "styremedlemmer", "styremedlemmene",
        "medlem", "medlemmer", "medlemmene", "nestleder", "nestlederen", "varamedlem", "signatur", "signaturen", "signaturrett", "prokura",
        "prokuristen", "prokurist", "prokurister", "fellesskap", "hver", "for", "seg", "alene", "eller", "og", "to", "tre", "fire", "ett", "en",
        "et", "av", "i", "med", "sammen", "selskapet", "selskapets", "foretaket", "foretakets", "firmaet", "firma", "firmaets", "tegnes", "tegner",
        "tegningsrett", "deltakerne", "deltaker", "deltakere", "komplementar", "komplementaren", "kommandittist", "administrerende", "direktør",
        "direktøren", "adm", "dir", "ceo", "chairman", "the", "board", "of", "directors", "and", "jointly", "alone", "two", "members", "member",
        "chair", "managing", "director", "daglige", "ledere", "generalforsamlingen", "kasserer", "sekretær", "sekretæren", "kassereren", "formann",
        "formannen", "nestformann", "styreformann", "styreformannen", "gruppe", "gruppen", "sameiet", "sameie", "borettslaget", "foreningen",
        "stiftelsen", "laget", "klubben", "rådet", "hele", "samlet", "samlede", "minst", "inntil", "over", "under", "kr", "nok", "beløp",
        "beløpsgrense", "også", "kan", "skal", "ved", "til", "om", "på", "fra", "den", "de", "det", "denne", "dette", "disse", "enten", "eventuelt",
        "alle", "samtlige", "øvrige", "andre", "annen", "nr", "jf", "iht", "signere", "signerer", "binde", "binder", "forplikte", "forplikter",
        "dagleg", "leiar", "leiaren", "styreleiar", "styreleiaren", "nestleiar", "åleine", "saman", "kvar", "eitt", "ein", "styremedlemene",
        "medlemene",
    ],
    "AT": [
        "geschäftsführer", "geschäftsführerin", "geschäftsführern", "geschäftsführers", "geschäftsleiter", "geschäftsleiterin", "prokurist",
        "prokuristin", "prokuristen", "prokuristinnen", "gesamtprokurist", "gesamtprokuristin", "gesamtprokuristen", "einzelprokurist",
        "einzelprokura", "gesamtprokura", "prokura", "vorstand", "vorstands", "vorstandes", "vorstandsmitglied", "vorstandsmitglieder",
        "vorstandsmitgliedern", "vorsitzende", "vorsitzender", "vorsitzenden", "vorstandsvorsitzende", "vorstandsvorsitzender", "stellvertreter",
        "stellvertreterin", "stellvertretendes", "vorstandsmitgliedes", "obmann", "obfrau", "obmannstellvertreter", "obfraustellvertreterin",
        "obmann-stellvertreter", "aufsichtsrat", "aufsichtsrats", "aufsichtsrates", "gesellschafter", "gesellschafterin", "gesellschaftern",
        "komplementär", "komplementärin", "kommanditist", "kommanditistin", "abwickler", "abwicklerin", "liquidator", "liquidatorin",
        "masseverwalter", "masseverwalterin", "vertreter", "vertreterin", "mitglied", "mitglieder", "mitgliedern", "firma", "gesellschaft",
        "zweigniederlassung", "zweigniederlassungen", "grundstücken", "grundstück", "grundstücke", "veräusserung", "veräußerung", "belastung",
        "berechtigung", "befugnis", "ermächtigung", "vertretung", "vertretungsbefugnis", "einzelvertretung", "gesamtvertretung", "abs", "ugb",
        "gmbhg", "aktg", "eur", "euro", "betrag", "beträge", "rechtsgeschäfte", "geschäfte", "zustimmung", "generalversammlung", "beschluss", "herr",
        "herrn", "frau", "gmbh", "ag", "kg", "og", "flexkapg",
    ],
    "DK": [
        "selskabet", "selskabets", "virksomheden", "virksomhedens", "foreningen", "fonden", "partnerselskabet", "kommanditselskabet",
        "interessentskabet", "andelsselskabet", "tegnes", "tegner", "tegningsret", "af", "en", "én", "et", "to", "tre", "fire", "fem", "direktør",
        "direktøren", "direktører", "direktørerne", "direktion", "direktionen", "direktionens", "administrerende", "adm", "dir", "samlede", "samlet",
        "bestyrelse", "bestyrelsen", "bestyrelsens", "bestyrelsesmedlem", "bestyrelsesmedlemmer", "bestyrelsesmedlemmerne", "medlem", "medlemmer",
        "medlemmerne", "formand", "formanden", "formandens", "næstformand", "næstformanden", "suppleant", "i", "forening", "med", "eller", "og",
        "alene", "hver", "for", "sig", "sammen", "den", "de", "det", "samtlige", "alle", "interessent", "interessenter", "interessenterne",
        "komplementar", "komplementaren", "komplementarer", "kommanditist", "prokura", "prokurist", "prokuristen", "prokurister", "filialbestyrer",
        "filialbestyreren", "filialbestyrere", "uddeler", "uddeleren", "tilsynsråd", "tilsynsrådet", "generalforsamlingen", "aps", "ivs", "amba",
        "fmba", "smba", "holding",
    ],
}

#: A word character of a mail address: letters, marks, digits and connecting signs.
_MAIL_PART = r"[\p{L}\p{M}\p{N}\p{Pc}-]+"
_EMAIL = rf"(?:{_MAIL_PART}|[.+])+@{_MAIL_PART}(?:\.{_MAIL_PART})+"
#: Styles of a date after a mark: day first, year first, year alone.
_DATES = [r"[0-9]{1,2}\.\s?[0-9]{1,2}\.\s?[0-9]{4}", r"[0-9]{4}(?:-[0-9]{2}){2}", r"(?:18|19|20)[0-9]{2}(?![\p{L}\p{N}_])"]


def _quoted(word: str) -> str:
    return "".join(c if c.isalnum() else f"\\{c}" for c in word)


_BIRTH = rf"(?iu)(?<![\p{{L}}\p{{N}}_])({'|'.join(map(_quoted, BIRTH_MARKS))})\s*:?\s*(?:{'|'.join(_DATES)})"


def _runs(text: Column) -> Column:
    """The text cut into runs of digits and hyphens, and what stands between them, in order."""
    return F.regexp_extract_all(text, F.lit("([0-9-]+|[^0-9-]+)"), F.lit(1))


def _personal_number(run: Column) -> Column:
    """Whether a run is nothing but a valid number of eleven digits."""
    return F.coalesce((F.length(run) == 11) & (valid_no_id(run) | valid_ee_id(run)), F.lit(False))


def _digits(c: Column) -> Column:
    return F.transform(F.split(c, ""), lambda d: d.cast("int"))


def _weighed(d: Column, weights: list[int]) -> Column:
    w = F.array(*[F.lit(x) for x in weights])
    return F.aggregate(F.zip_with(F.slice(d, 1, len(weights)), w, lambda a, b: a * b), F.lit(0), lambda s, x: s + x) % 11


def valid_no_id(c: Column) -> Column:
    """Eleven digits with both control digits right."""
    d = _digits(c)

    def right(weights: list[int]) -> Column:
        k = (11 - _weighed(d, weights)) % 11
        return F.get(d, F.lit(len(weights))) == k

    return F.when(c.rlike(r"^\d{11}$"), right(NO_WEIGHTS[0]) & right(NO_WEIGHTS[1])).otherwise(F.when(c.isNotNull(), False))


def valid_ee_id(c: Column) -> Column:
    """Eleven digits: century, a real date, a serial number and a control digit of two stages."""
    d = _digits(c)
    century = F.get(F.array(*[F.lit(x) for x in (18, 18, 19, 19, 20, 20, 21, 21)]), F.get(d, F.lit(0)) - 1)
    date = F.try_to_date(F.concat(century.cast("string"), F.substring(c, 2, 6)), "yyyyMMdd")
    one, two = _weighed(d, EE_WEIGHTS[0]), _weighed(d, EE_WEIGHTS[1])
    k = F.when(one < 10, one).when(two < 10, two).otherwise(0)
    return F.when(c.rlike(r"^[1-8]\d{10}$"), date.isNotNull() & (F.get(d, F.lit(10)) == k)).otherwise(F.when(c.isNotNull(), False))


def redact(text: Column) -> Column:
    """Text with valid identity numbers as [ID], birth dates after a mark as [DATE] and e-mail addresses as [EMAIL]."""
    plain = F.array_join(F.transform(_runs(text), lambda r: F.when(_personal_number(r), F.lit("[ID]")).otherwise(r)), "")
    return F.regexp_replace(F.regexp_replace(plain, _BIRTH, "$1 [DATE]"), _EMAIL, "[EMAIL]")


def redactions(text: Column) -> Column:
    """Number of replacements that `redact` makes."""
    return F.size(F.filter(_runs(text), _personal_number)) + F.regexp_count(text, F.lit(_BIRTH)) + F.regexp_count(text, F.lit(_EMAIL))


def _name_form(c: Column) -> Column:
    """Comparison form of a name or a part of one: lower case, with single spaces for blanks and hyphens."""
    return F.lower(F.trim(F.regexp_replace(c, r"[\s\x{A0}-]+", " ")))


def mask_names(text: Column, names: Column, vocabulary: list[str] = ()) -> Column:
    """Text with the names of a list as [PERSON_n], numbered by first appearance: whole names and, of three letters or more,
    their parts that are no words of the vocabulary. A possessive ending goes with the name.

    One pass from left to right: the text is cut at the names, the longest first at each place; every name found is looked up
    and numbered, and the cuts are filled in order."""
    none = F.array().cast("array<string>")
    people = F.array_distinct(F.filter(F.transform(F.coalesce(names, none), _name_form), lambda n: n != ""))
    vocab = F.array(*[F.lit(v) for v in vocabulary]) if vocabulary else none
    parts = lambda n, i: F.transform(F.filter(F.split(n, " "), lambda p: (F.length(p) >= 3) & ~F.array_contains(vocab, p)), lambda p: F.struct((-F.length(p)).alias("w"), i.alias("i"), p.alias("n")))
    whole = F.array_sort(F.transform(people, lambda n, i: F.struct((-F.length(n)).alias("w"), i.alias("i"), n.alias("n"))))
    known = F.concat(whole, F.array_sort(F.flatten(F.transform(people, parts))))
    quoted = F.transform(known, lambda x: F.regexp_replace(F.regexp_replace(x.getField("n"), r"([^\p{L}\p{N} ])", r"\\$1"), " ", r"[\\s\\x{A0}-]+"))
    pattern = F.concat(F.lit(r"(?iU)(?<!\w)("), F.array_join(quoted, "|"), F.lit(r")(?:'?s)?(?!\w)"))
    # Every name found, as the first of the known ones that it is; persons in order of appearance.
    said = F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), lambda m: F.get(F.filter(known, lambda x: x.getField("n") == _name_form(m)), F.lit(0)).getField("i"))
    persons = F.array_distinct(said)
    tokens = F.transform(said, lambda i: F.concat(F.lit("[PERSON_"), F.array_position(persons, i).cast("string"), F.lit("]")))
    between = F.split(text, pattern, -1)
    filled = F.array_join(F.zip_with(between, tokens, lambda t, k: F.concat(t, F.coalesce(k, F.lit("")))), "")
    return F.when(F.size(people) > 0, filled).otherwise(text)


def residual_name(text: Column, vocabulary: list[str], forms: tuple[str, ...] = ("AS", "ASA", "ANS", "DA", "KS", "SA", "GmbH", "ApS")) -> Column:
    """Whether a capitalised word that is none of the vocabulary stands elsewhere than at the start of a sentence,
    and isn't part of a firm's name (capitalised words before a legal form)."""
    firms = rf"(?U)(?:\b\p{{Lu}}[\p{{L}}'\-]*\s+)+(?:{'|'.join(forms)})\b"
    vocab = F.array(*[F.lit(v) for v in vocabulary]) if vocabulary else F.array().cast("array<string>")
    sentences = F.split(F.regexp_replace(text, firms, "firma"), r"[.!?]\s+")

    def risky(s: Column) -> Column:
        words = F.regexp_extract_all(s, F.lit(r"(?U)(\[PERSON_\d+\]|\p{L}+(?:['\-]\p{L}+)*)"), F.lit(1))
        rest = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
        known = lambda w: F.forall(F.split(F.lower(w), r"['\-]"), lambda p: F.array_contains(vocab, p))
        return F.exists(rest, lambda w: w.rlike(r"(?U)^\p{Lu}") & (w != F.upper(w)) & ~known(w))

    return F.coalesce(F.exists(sentences, risky), F.lit(False))


def personal_key(key: Column) -> Column:
    """Whether a key names a personal identifier."""
    from .keys import ascii_key

    return ascii_key(key).isin(PERSONAL_KEYS)
