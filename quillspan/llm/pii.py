"""Operator 2, PII surrogates: keyed, type-consistent replacements that stay distinct and coreferent.

Detected are e-mail addresses, phone numbers, IP addresses (4 and 6), payment cards, social security numbers,
IBANs and person names (a known given name, a title or a word like "Dear" or "Contact:" before capitalised
words; names without such a sign are not found). Dates and bare runs of numbers are no phones. A surrogate keeps
the entity's form: digits become digits and letters letters in their places, case and script stay, card and
IBAN check digits stay right (or wrong), private addresses stay private, country codes stay, a given name
becomes one of its gender and script, and a family name keeps its pattern of vowels and consonants.

All of it is enciphered by keyed Feistel networks over the entity's own digits, letters, vowels or consonants,
which are permutations, and a given name by a permutation of its list: two entities of one form never get one
surrogate, and one entity gets the same one everywhere, however it is punctuated or capitalised. What is left
to the collision check, over the whole corpus, is a surrogate that is itself an original there, or that entities
of different rounds share: their originals get another round of the key, until none is left. Given names are
not checked against originals, as a list's names are all likely ones.

Defined results: null texts stay null; a text without entities stays as it is; of overlapping
entities the first stands, then the longest; repeated rows get equal surrogates, and rows with a null doc_id their own
rounds too. All columns of the input stay in `replace_docs`; if it has columns n_entities or entity_kinds, the new ones
take their place.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, mapped, only, row_key

KEY = b"replace this key in production"
#: Given names by script and gender, and family names by script.
NAMES = {
    ("latin", "f"): "Alice Anna Barbara Carla Carmen Claire Claudia Elena Emma Eva Helen Ingrid Isabel Jane Julia Karen Laura Linda Lucia Maria Martha Mary Nina Olga Paula Rosa Sarah Sofia Susan Ursula Priya Aisha Fatima Ana Chiara Yuki Mei".split(),
    ("latin", "m"): "Albert Andreas Anthony Carlos Charles Daniel David Diego Eric Frank George Hans Henry Jack James John Jorge Juan Karl Louis Martin Michael Oscar Paul Peter Pierre Robert Thomas Victor William José Jürgen Mohammed Ahmed Raj Luca Marco Kenji Wei".split(),
    ("cyrillic", "f"): "Анна Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия Вера".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей".split(),
    ("greek", "f"): "Άννα Ελένη Κατερίνα Μαρία Σοφία Ειρήνη".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Κώστας Νίκος Πέτρος Ανδρέας".split(),
}
#: Vowels and consonants of each script, in turn.
LETTERS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöü", "çñšžčřłń", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρσςτφχψ", "άέήίόύώ")
TITLES = {"m": "Mr Mister Sir Herr Monsieur Señor Sr".split(), "f": "Mrs Ms Miss Madam Frau Madame Mme Señora Sra".split(), "": "Dr Prof Professor Doctor".split()}
#: Capitalised words that follow titles and cues without being names.
NO_NAMES = set("Sir Madam All Team Customer Friends Colleagues Chair President Minister Doctor Professor The".split())
GENDER = {n: (s, g) for (s, g), names in NAMES.items() for n in names}

EMAIL = re.compile(r"(?<![\w.+%-])([A-Za-z0-9_.+%-]+)@((?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+)([A-Za-z]{2,24})(?![\w-])")
NUMBER = re.compile(r"(?<![\w.])(?:(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))|(?P<ssn>\d{3}-\d{2}-\d{4}(?![\w-]))|(?P<card>\d(?:[ -]?\d){12,18}(?![\w]))|(?P<phone>(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{2,4}(?:[ .-]\d{2,4}){1,3}(?!\w)|\+\d{9,14}(?!\w)))")
PLUS = re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w(])\(\d{2,4}\)[ .-]?\d{2,4}(?:[ .-]\d{2,4}){1,3}(?!\w)")
#: What dates look like, and what a number without a leading +, ( or 0 must look like to be a phone's.
DATE = re.compile(r"\d{4}[-./ ]\d{1,2}[-./ ]\d{1,2}|\d{1,2}[-./ ]\d{1,2}[-./ ]\d{2,4}")
LOCAL = re.compile(r"(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}")
SHORT = re.compile(r"(?<![\w.-])\d{3}-\d{4}(?![\w-])")
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
#: The country codes of one and two digits; all others have three.
COUNTRY = {"1", "7"} | set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_CAPITAL = r"[^\W\d_a-zà-öø-ÿа-яα-ω](?:\w*['’-]?\w+)+|[\u4E00-\u9FA5]{2,4}"
CUES = "Dear|Regards,|Sincerely,|Contact:|Name:|From:|To:|Attn:|Signed:|Patient:|Customer:"
NAME = re.compile(rf"(?<!\w)(?:(?:(?P<title>{'|'.join(t for ts in TITLES.values() for t in ts)})\.?|{CUES})[ ](?P<a>{_CAPITAL})(?:[ ](?P<b>{_CAPITAL}))?|(?P<given>{'|'.join(GENDER)})(?:[ ](?P<family>{_CAPITAL}))?)(?!\w)")
DIGIT = re.compile(r"\d")
KINDS = ("email", "ip", "ipv6", "ssn", "card", "phone", "iban", "name")
Found = tuple[int, int, str, str]  # start, end, kind, canonical value


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def is_phone(value: str) -> bool:
    if not 7 <= len(DIGIT.findall(value)) <= 15 or DATE.fullmatch(value):
        return False
    return value[0] in "+(0" or bool(LOCAL.fullmatch(value))


def country(digits: str) -> str:
    return next((digits[:n] for n in (1, 2) if digits[:n] in COUNTRY), digits[:3])


def sound_ipv6(value: str) -> bool:
    try:
        return ipaddress.IPv6Address(value) is not None and len(value) > 6
    except ValueError:
        return False


def canonical(kind: str, value: str) -> str:
    """What all mentions of one entity share."""
    if kind == "email":
        return value.lower()
    if kind in ("ssn", "card"):
        return "".join(DIGIT.findall(value))
    if kind == "phone":
        digits = "".join(DIGIT.findall(value))
        if value[0] != "+":
            return digits
        code = country(digits)
        return f"+{code} {digits[len(code) :]}"
    if kind == "ipv6":
        return ipaddress.IPv6Address(value).exploded
    if kind == "iban":
        return value.replace(" ", "")
    return value if value in GENDER else value[:1] + value[1:].lower() if value.isupper() else value


def find(text: str | None) -> list[Found]:
    """Entities in order, without overlaps."""
    if not text:
        return []
    got: list[tuple[int, int, str]] = []
    if "@" in text:
        got += [(*m.span(), "email") for m in EMAIL.finditer(text)]
    if DIGIT.search(text):
        got += [(*m.span(), m.lastgroup) for m in NUMBER.finditer(text) if m.lastgroup != "phone" or is_phone(m[0])]
        got += [(*m.span(), "phone") for m in PLUS.finditer(text) if 7 <= len(DIGIT.findall(m[0])) <= 15]
        got += [(*m.span(), "phone") for m in SHORT.finditer(text)]
        if ":" in text:
            got += [(*m.span(), "ipv6") for m in IPV6.finditer(text) if sound_ipv6(m[0])]
        got += [(*m.span(), "iban") for m in IBAN.finditer(text)]
    for m in NAME.finditer(text):
        for group in ("a", "b", "given", "family"):
            if m[group] and m[group] not in NO_NAMES:
                got.append((*m.span(group), "name"))
    out, end = [], 0
    for a, b, kind in sorted(got, key=lambda x: (x[0], -x[1])):
        if a >= end:
            out.append((a, b, kind, canonical(kind, text[a:b])))
            end = b
    return out


def number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "replace"), key=key[:64], digest_size=16).digest())


def permuted(key: bytes, tweak: str, symbols: list[int], radix: int, rounds: int = 10) -> list[int]:
    """A keyed permutation of the strings of this length over range(radix)."""
    n = len(symbols)
    if n < 2:
        return [(s + number(key, tweak, radix)) % radix for s in symbols]
    half = n // 2
    value = lambda x: sum(s * radix**i for i, s in enumerate(reversed(x)))
    a, b, na, nb = value(symbols[:half]), value(symbols[half:]), half, n - half
    for r in range(rounds):
        a, b, na, nb = b, (a + number(key, tweak, n, r, b)) % radix**na, nb, na
    both = []
    for v, m in ((a, na), (b, nb)):
        both += [v // radix ** (m - 1 - i) % radix for i in range(m)]
    return both


def enciphered(key: bytes, tweak: str, text: str) -> str:
    """Digits and ASCII letters permuted, each kind in its own places; all else stays."""
    out = list(text)
    for base, size in (("0", 10), ("a", 26), ("A", 26)):
        at = [i for i, c in enumerate(text) if ord(base) <= ord(c) < ord(base) + size]
        for i, s in zip(at, permuted(key, f"{tweak}{base}", [ord(text[i]) - ord(base) for i in at], size), strict=True):
            out[i] = chr(ord(base) + s)
    return "".join(out)


def walk(key: bytes, tweak: str, text: str, inside) -> str:
    """Enciphers until the result has the property that the text has: still a permutation, of those with it."""
    new = enciphered(key, tweak, text)
    while not inside(new):
        new = enciphered(key, tweak, new)
    return new


def network(octets: list[int]) -> int:
    """How many leading bits say what kind of address it is: private, local, multicast; 0 for public ones."""
    a, b = octets[:2]
    return 8 if a in (10, 0, 127) else 16 if (a, b) == (192, 168) else 12 if a == 172 and 16 <= b < 32 else 4 if a >= 224 else 0


def iban_check(value: str) -> str:
    digits = "".join(str(int(c, 36)) for c in value[4:] + value[:2] + "00")
    return f"{98 - int(digits) % 97:02d}"


@lru_cache(maxsize=50_000)
def surrogate(kind: str, value: str, key: bytes = KEY, turn: int = 0) -> str:
    """The replacement of a canonical value."""
    tweak = f"{kind}/{turn}"
    if kind == "email":
        local, _, domain = value.partition("@")
        head, _, top = domain.rpartition(".")
        return f"{enciphered(key, tweak, local)}@{enciphered(key, tweak + '@', head)}.{top}"
    if kind == "ip":
        octets = [int(x) for x in value.split(".")]
        bits = [o >> (7 - i) & 1 for o in octets for i in range(8)]
        fixed = network(octets)
        while True:
            bits = bits[:fixed] + permuted(key, f"{tweak}{bits[:fixed]}", bits[fixed:], 2)
            new = [int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, 32, 8)]
            if network(new) == fixed:
                return ".".join(map(str, new))
    if kind == "card":
        return walk(key, tweak, value, lambda x: luhn(x) == luhn(value))
    if kind == "ssn":
        sound = lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"
        return walk(key, tweak, value, lambda x: sound(x) == sound(value))
    if kind == "phone":
        code, _, rest = value.rpartition(" ")
        return f"{code} {enciphered(key, tweak, rest)}".strip() if code else enciphered(key, tweak, value)
    if kind == "iban":
        body = value[:2] + "00" + enciphered(key, tweak, value[4:])
        right = iban_check(value) == value[2:4]
        check = iban_check(body)
        return body[:2] + (check if right else f"{(int(check) + 1 + number(key, tweak, value) % 96) % 100:02d}") + body[4:]
    if kind == "ipv6":
        head, rest = value[:20], value[20:].replace(":", "")  # the network stays
        new = "".join(f"{d:x}" for d in permuted(key, tweak, [int(c, 16) for c in rest], 16))
        return head + ":".join(new[i : i + 4] for i in range(0, len(new), 4))
    if known := GENDER.get(value):  # a permutation of the list
        order = sorted(NAMES[known], key=lambda n: number(key, "name", n))
        return order[(order.index(value) + 1) % len(order)]
    return spelt(key, tweak, value)


def spelt(key: bytes, tweak: str, name: str) -> str:
    """Letters permuted among those of their kind (vowel or consonant of a script; other letters by code): a pronounceable name."""
    out = list(name)
    kinds: dict[str, list[int]] = {}
    for i, c in enumerate(name):
        if (kind := next((k for k in LETTERS if c.lower() in k), None)) is not None:
            kinds.setdefault(kind, []).append(i)
        elif "\u4e00" <= c <= "\u9fa5":
            kinds.setdefault("", []).append(i)
    pattern = "".join("-" if i in kinds.get("", ()) else "a" if any(name[i].lower() in k for k in LETTERS[::2]) else "b" for i in range(len(name)))
    for kind, at in kinds.items():
        values = [kind.index(name[i].lower()) if kind else ord(name[i]) - 0x4E00 for i in at]
        for i, v in zip(at, permuted(key, f"{tweak}/{pattern}/{kind}", values, len(kind) or 0x51A6), strict=True):
            out[i] = (kind[v].upper() if name[i].isupper() else kind[v]) if kind else chr(0x4E00 + v)
    return "".join(out)


def shaped(kind: str, original: str, new: str) -> str:
    """A canonical surrogate in the punctuation and case of the mention."""
    if kind in ("phone", "ssn", "card", "iban"):
        symbols = iter(re.sub(r"[^0-9A-Za-z]", "", new))
        return "".join(next(symbols) if c.isascii() and c.isalnum() else c for c in original)
    if kind == "email":
        return "".join(n.upper() if o.isupper() else n for o, n in zip(original, new, strict=True))
    if kind == "name" and original.isupper():
        return new.upper()
    return new


def replaced(text: str | None, turns: dict[tuple[str, str], int] | None = None, key: bytes = KEY) -> str | None:
    found = find(text)
    if not found:
        return text
    out, end = [], 0
    for a, b, kind, value in found:
        new = surrogate(kind, value, key, turns.get((kind, value), 0) if turns else 0)
        out += [text[end:a], shaped(kind, text[a:b], new)]
        end = b
    return "".join([*out, text[end:]])


ENTITY = "kind string, value string"


def entities(docs: DataFrame) -> DataFrame:
    """(row, found: array of (kind, value)) of each row; row is its key."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [[{"kind": k, "value": v} for _, _, k, v in find(t.as_py())] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(got, kind)], ["row", "found"])

    return only(docs, "doc_id", "text").select(row_key().alias("row"), "text").mapInArrow(run, "row long, found array<struct<kind:string,value:string>>")


def with_surrogates(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("kind", "value", "turn")), strict=True))
            new = [surrogate(k, v, key, t) for k, v, t in rows]
            checked = [not (k == "name" and v in GENDER) for k, v, _ in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string()), pa.array(checked, pa.bool_())], [*batch.schema.names, "new", "checked"])

    return run


def checked_turns(values: DataFrame, scratch: Scratch, key: bytes = KEY) -> DataFrame:
    """(kind, value, turn) of those distinct values(kind, value) that need another round of the key.

    Surrogates are nearly all different, so no key of these joins is hot. A value that clashes takes another round;
    each has fewer clashes than the one before, by the share of its form that originals take up.
    """
    state = scratch.keep(values.distinct().withColumn("turn", F.lit(0)))
    while True:
        named = scratch.keep(state.mapInArrow(with_surrogates(key), f"{ENTITY}, turn int, new string, checked boolean").where("checked"))
        original = named.join(state.select("kind", F.col("value").alias("new")), ["kind", "new"], "left_semi").where(BIG_ENOUGH).select("kind", "value")
        # of several with one surrogate the one of the earliest round and least hash keeps it
        first = named.groupBy("kind", "new").agg(F.min(F.struct("turn", F.xxhash64("value"), "value")).alias("keeper"), F.count("*").alias("n")).where("n > 1")
        clash = named.join(first, ["kind", "new"]).where(F.col("value") != F.col("keeper.value")).select("kind", "value")
        again = scratch.keep(original.union(clash).distinct())
        if not again.limit(1).count():
            return state.where("turn > 0")
        state = scratch.keep(state.join(again.withColumn("again", F.lit(1)), ["kind", "value"], "left").select("kind", "value", (F.col("turn") + F.coalesce("again", F.lit(0))).alias("turn")))


#: Forms with so few values that originals may take them all up are not checked against originals.
BIG_ENOUGH = "length(value) > 4"


def replace_docs(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """docs with `text` replaced, and columns n_entities and entity_kinds (sorted, distinct) added."""
    scratch = Scratch(docs.sparkSession, "op2")
    found = scratch.keep(entities(docs).where(F.size("found") > 0))
    every = found.select("row", F.inline("found"))
    turns = scratch.keep(checked_turns(every.select("kind", "value"), scratch, key))
    # only rows that mention a value of a later round need to be told
    told = every.distinct().join(turns, ["kind", "value"]).groupBy(F.col("row").alias("__row")).agg(F.collect_list(F.struct("kind", "value", "turn")).alias("__turns"))
    names = [n for n in docs.columns if n not in ("n_entities", "entity_kinds")]
    docs = only(docs, *names)
    if turns.limit(1).count():
        ready = docs.join(told, row_key() == told["__row"], "left").drop("__row")
    else:
        ready = docs.withColumn("__turns", F.lit(None).cast("array<struct<kind:string,value:string,turn:int>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = names.index("text")
        for batch in batches:
            texts, counts, kinds = [], [], []
            for text, turn in zip(batch.column(place), batch.column(len(names)), strict=True):
                text = text.as_py()
                known = {(t["kind"], t["value"]): t["turn"] for t in turn.as_py() or ()}
                got = find(text)
                texts.append(replaced(text, known, key))
                counts.append(len(got))
                kinds.append(",".join(sorted({k for _, _, k, _ in got})))
            columns = list(batch.columns[: len(names)])
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], [*batch.schema.names[: len(names)], "n_entities", "entity_kinds"])

    return mapped(only(ready, *names, "__turns"), run, "n_entities long, entity_kinds string", len(names))
