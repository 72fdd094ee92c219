"""Personal data replaced by surrogates: keyed, of the same type and form, distinct for distinct entities.

Detected are e-mail addresses, phone numbers, payment cards (with valid check digit), IPv4 addresses, US social security
numbers, IBANs (with valid check digits), and names: after a form of address, after "my name is" and the like, and where a
customary given name stands before a capitalised one. Every entity has a canonical form, so one number written in two ways
is one entity, and its surrogate is a function of key, kind and canonical form: numbers keep their length, separators,
leading country code and valid check digits, e-mails their pattern of letters (by script) and digits, addresses their
network class, names their script, gender and capitals. Digits and letters go through a keyed permutation of all values of
that form, so whoever has the key can undo it, and nobody else.

Spark then checks all distinct entities of the corpus: a surrogate that two entities share, or that is itself an entity of
the corpus, is drawn again (the smallest entity keeps a shared one). Names and e-mail names grow by a character for each
draw from the ``GROW``-th on, so they always end. Kinds of a fixed form can run out of values: if an entity has none after
``ATTEMPTS`` draws (at half of all values in use, one in 2 ** 24), its whole form (all entities of that kind and ``shape``)
takes the plain permutation, which keeps all of them distinct but may give one the value of another. Only entities drawn
again need a table: it is broadcast while small, and else joined to the documents that hold them.

Defined cases: null texts stay null; empty texts and texts without entities stay as they are; texts of any length are read
whole; repeated rows are replaced alike; rows without a doc_id, or with one that repeats, are rewritten each by its own text;
an empty table gives no rows; all columns, whatever their names, are kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tarn.llm.common import SLICE, bounded, persisted, slices

KINDS = ("email", "iban", "card", "ip", "ssn", "phone", "given_f", "given_m", "given_x", "surname")
GROW, ATTEMPTS = 8, 24
#: Attempt that stands for the plain permutation of a form without free values.
PLAIN = -1
BROADCAST = 500_000

# Forms of address and the gender they tell.
ADDRESS = {
    "Mr": "m", "Mister": "m", "Monsieur": "m", "Herr": "m", "Señor": "m", "Sr": "m", "Господин": "m", "Κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Frau": "f", "Señora": "f", "Sra": "f",
    "Señorita": "f", "Госпожа": "f", "Κυρία": "f", "Dr": "x", "Prof": "x",
    "السيد": "m", "السيدة": "f", "מר": "m", "גברת": "f", "श्री": "m", "श्रीमती": "f",
}
# Customary given names and the gender they tell.
GIVEN = {
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Sandra Ashley Emily Donna Michelle Carol Amanda Melissa "
    "Anna Maria Laura Julia Sophie Emma Olivia Hannah Lena Claudia Sabine Monika Petra Ingrid Marie Camille Chloé Élodie Nathalie Isabelle "
    "Carmen Lucía Sofía Elena Ana Isabel Pilar Анна Мария Елена Ольга Наталья Татьяна Ирина Μαρία Ελένη",
    "m": "James Robert John Michael David William Richard Joseph Thomas Charles Daniel Matthew Anthony Steven Paul Andrew Kenneth Kevin Brian George "
    "Peter Hans Klaus Jürgen Stefan Andreas Wolfgang Martin Felix Lukas Jean Pierre Michel Philippe Nicolas François Luc Antoine "
    "José Juan Carlos Luis Miguel Pedro Javier Иван Александр Сергей Дмитрий Андрей Алексей Михаил Γιώργος Νίκος",
}
GENDER = {name: gender for gender, names in GIVEN.items() for name in names.split()}
# Ranges of letters, by alphabet; a letter's surrogate is one of its range.
RANGES = [("a", "z"), ("à", "ö"), ("ø", "ÿ"), ("а", "я"), ("α", "ω"), ("ա", "ֆ"), ("א", "ת"), ("ا", "غ"), ("ف", "ي"), ("अ", "ह"), ("ก", "ฮ"), ("ა", "ჰ"), ("ぁ", "ん"), ("ァ", "ン"), ("가", "힣"), ("一", "鿿")]
# Syllables of made-up names and the endings by gender, by script.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe fo ga ka ke ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se so ta te to va ve vi".split(),
    "cyrillic": "ба бе бо да де до га ка ке ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се со та те то ва ве ви".split(),
    "greek": "βα γα γε δα δε δο θα θε κα κε κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε σο τα τε το φα".split(),
}
ENDINGS = {
    "latin": {"given_f": "na", "given_m": "n", "given_x": "s", "surname": "r"},
    "cyrillic": {"given_f": "на", "given_m": "н", "given_x": "с", "surname": "в"},
    "greek": {"given_f": "να", "given_m": "νος", "given_x": "σι", "surname": "ρης"},
}

_EMAIL = re.compile(r"[\w.%+-]+@[^\W_](?:[^\W_]|-)*(?:\.(?:[^\W_]|-)+)*\.[^\W\d_]{2,}")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CARD = re.compile(r"(?<![\w.+-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)")
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_PHONE = re.compile(
    r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w)"
)
_PART = r"([^\W\d_](?:[\w'’-]|[ऀ-ॿ])+)"
_NAMES = re.compile(rf" {_PART}(?: {_PART})?")
_SAID = re.compile(r"(?:[Mm]y name is|[Nn]ame:|[Ss]igned by)(?= )")
#: Words that don't begin in lower case.
_WORD = re.compile(r"(?<!\w)[^\W\d_a-zß-öø-ÿа-яα-ω](?:\w|[ऀ-ॿ])+")
_HINT = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def iban_valid(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _phone(text: str) -> str:
    code = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d", text)
    return f"{code[0] if code else ''}|{_digits(text[code.end() if code else 0 :])}"


def _capital(name: str) -> bool:
    """Whether it begins as names do: with a capital, or in a script that has none."""
    return name[0].isupper() or name[0].upper() == name[0].lower()


def _named(gender: str, *parts: tuple[int, str | None]) -> list[tuple[int, int, str, str]]:
    """The name of one or two parts (start, text; text None: not there): its last part is the surname."""
    held = [p for p in parts if p[1] and _capital(p[1])]
    if not held or held[0] != parts[0]:
        return []
    return [(at, at + len(name), f"given_{gender}" if k < len(held) - 1 else "surname", name.lower()) for k, (at, name) in enumerate(held)]


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities, in order, none inside another."""
    found = []
    if _HINT.search(text):
        for kind, pattern, canonical, valid in (
            ("email", _EMAIL, str.lower, lambda c: True),
            ("iban", _IBAN, lambda t: t.replace(" ", ""), iban_valid),
            ("card", _CARD, _digits, luhn),
            ("ip", _IP, str, lambda c: True),
            ("ssn", _SSN, _digits, lambda c: True),
            ("phone", _PHONE, _phone, lambda c: len(c) >= 8),
        ):
            for m in pattern.finditer(text):
                form = canonical(m[0])
                if valid(form):
                    found.append((m.start(), m.end(), kind, form))
    for m in _WORD.finditer(text):
        if m[0] in ADDRESS and (n := _NAMES.match(text, m.end() + text.startswith(".", m.end()))):
            found += _named(ADDRESS[m[0]], (n.start(1), n[1]), (n.start(2), n[2]))
        elif m[0] in GENDER and (n := _NAMES.match(text, m.end())) and _capital(n[1]):
            found += _named(GENDER[m[0]], (m.start(), m[0]), (n.start(1), n[1]))
    if "name" in text or "igned by" in text:
        for m in _SAID.finditer(text):
            if n := _NAMES.match(text, m.end()):
                found += _named(GENDER.get(n[1], "x"), (n.start(1), n[1]), (n.start(2), n[2]))
    found.sort(key=lambda f: (f[0], KINDS.index(f[2])))
    kept, end = [], 0
    for one in found:
        if one[0] >= end:
            kept.append(one)
            end = one[1]
    return kept


def _random(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), key=key, digest_size=32).digest(), "little")


def permuted(value: int, size: int, key: bytes, *tweak: object) -> int:
    """A keyed permutation of range(size): Feistel rounds over a x b >= size, walked until inside."""
    if size < 2:
        return value
    a = 1
    while a * a < size:
        a <<= 1
    while a > 1 and (a >> 1) * (a >> 1) >= size:
        a >>= 1
    while True:
        left, right = divmod(value, a)
        for k in range(8):
            left, right = right, (left + _random(key, tweak, k, right)) % a
        value = left * a + right
        if value < size:
            return value


def _alphabet(c: str) -> tuple[str, int]:
    """First letter and size of the range that a character's surrogate is from; size 1: it stays."""
    if c in "0123456789":
        return "0", 10
    if c.isalpha():
        for first, last in RANGES:
            if first <= c <= last:
                return first, ord(last) - ord(first) + 1
    return c, 1


def _pattern(text: str, key: bytes, *tweak: object) -> str:
    """Letters to letters of their alphabet and digits to digits, as one permutation of all lower-case texts of that pattern."""
    value, size = 0, 1
    alphabets = [_alphabet(c) for c in text]
    for c, (first, n) in zip(text, alphabets, strict=True):
        value, size = value * n + ord(c) - ord(first), size * n
    value = permuted(value, size, key, *tweak, tuple(alphabets))
    out = []
    for first, n in reversed(alphabets):
        value, k = divmod(value, n)
        out.append(chr(ord(first) + k))
    return "".join(reversed(out))


def _number(digits: str, key: bytes, *tweak: object) -> str:
    """Digits of the same length; a leading 0 stays one, others don't become one."""
    if not digits:
        return digits
    low = 0 if digits[0] == "0" else 10 ** (len(digits) - 1)
    size = 10 ** (len(digits) - 1) * (1 if digits[0] == "0" else 9)
    return str(permuted(int(digits) - low, size, key, *tweak, len(digits)) + low).zfill(len(digits))


def _free(digits: str, key: bytes, *tweak: object) -> str:
    return str(permuted(int(digits), 10 ** len(digits), key, *tweak, len(digits))).zfill(len(digits))


def _network(value: int) -> tuple[int, int]:
    """(first address, size) of the private or reserved network that holds the address; (0, 2 ** 32) for public ones."""
    for first, bits in ((10 << 24, 24), (172 << 24 | 16 << 16, 20), (192 << 24 | 168 << 16, 16), (127 << 24, 24), (0, 24), (224 << 24, 29)):
        if first <= value < first + (1 << bits):
            return first, 1 << bits
    return 0, 1 << 32


def script(text: str) -> str:
    """latin, cyrillic or greek, or other: the scripts without syllables here."""
    c = next((c for c in text if c.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin" if c < "ɐ" or "Ḁ" <= c <= "ỿ" else "other"


def shape(kind: str, form: str) -> str:
    """What entities of one kind have in common if their surrogates are values of one permutation; empty for kinds that grow."""
    if kind == "ip":
        return str(_network(_address(form)))
    if kind == "phone":
        code, rest = form.split("|")
        return f"{code}|{len(rest)}|{rest[:1] == '0'}"
    if kind in ("ssn", "card"):
        return f"{len(form)}|{form[0] if kind == 'card' else form[0] == '0'}"
    if kind == "iban":
        return form[:2] + "".join("9" if c.isdigit() else "A" for c in form[4:])
    return ""


def _address(ip: str) -> int:
    return sum(int(o) << s for o, s in zip(ip.split("."), (24, 16, 8, 0), strict=True))


def surrogate(kind: str, form: str, attempt: int, key: bytes) -> str:
    """The canonical form of the entity's surrogate."""
    longer = max(0, attempt - GROW)
    if kind == "email":
        local, domain = form.rsplit("@", 1)
        name, top = domain.rsplit(".", 1)
        return _pattern(local + "0" * longer, key, kind, attempt) + "@" + _pattern(name, key, "domain") + "." + top
    if kind == "phone":
        code, rest = form.split("|")
        return f"{code}|{_number(rest, key, kind, code, attempt)}"
    if kind == "ssn":
        return _number(form, key, kind, attempt)
    if kind == "card":
        body = form[0] + _free(form[1:-1], key, kind, form[0], attempt)
        return body + next(d for d in "0123456789" if luhn(body + d))
    if kind == "ip":
        value = _address(form)
        first, size = _network(value)
        while True:
            value = first + permuted(value - first, size, key, kind, attempt)
            if _network(value) == (first, size):
                return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))
    if kind == "iban":
        body = _pattern(form[4:].lower(), key, kind, form[:2], attempt).upper()
        return form[:2] + next(f"{k:02d}" for k in range(2, 99) if iban_valid(f"{form[:2]}{k:02d}{body}")) + body
    if script(form) == "other":
        return _pattern(form + form[-1] * longer, key, kind, attempt)
    kinds = SYLLABLES[script(form)]
    n = _random(key, kind, form, attempt)
    made = []
    for _ in range(3 + longer):
        n, k = divmod(n, len(kinds))
        made.append(kinds[k])
    return "".join(made) + ENDINGS[script(form)][kind]


def render(original: str, kind: str, form: str) -> str:
    """The surrogate's canonical form written as the original was."""
    if kind in ("phone", "card", "ssn", "iban"):
        code, rest = form.split("|") if kind == "phone" else ("", form)
        out, at = [code], 0
        for c in original[len(code) :]:
            if c.isascii() and c.isalnum():
                out.append(rest[at])
                at += 1
            else:
                out.append(c)
        return "".join(out) + rest[at:]
    if kind == "email":
        same = len(original) == len(form)
        return "".join(f.upper() if o.isupper() else f for o, f in zip(original, form, strict=True)) if same else form
    if kind == "ip":
        return form
    return form.upper() if original.isupper() and len(original) > 1 else form[0].upper() + form[1:]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, kind, form), each entity once a text."""
    for batch in slices(batches, most=SLICE):
        owner, kinds, forms = [], [], []
        for k, text in enumerate(batch.column(1).to_pylist()):
            for kind, form in sorted({x[2:] for x in detect(text)}) if text else ():
                owner.append(k)
                kinds.append(kind)
                forms.append(form)
        ids = batch.column(0).take(pa.array(owner, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(kinds, pa.string()), pa.array(forms, pa.string())], ["doc_id", "kind", "form"])


def _drawn(key: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, forms, attempts = (c.to_pylist() for c in batch.columns)
        made = [surrogate(k, f, a, key) for k, f, a in zip(kinds, forms, attempts, strict=True)]
        shapes = [shape(k, f) for k, f in zip(kinds, forms, strict=True)]
        columns = [*batch.columns, pa.array(made, pa.string()), pa.array(shapes, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "form", "attempt", "made", "shape"])


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """Distinct (kind, form) -> (kind, form, attempt, made), where no two share a surrogate and none is an entity.

    What a form without free values gets is told above.
    """

    def draw(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(lambda b: _drawn(key, b), "kind string, form string, attempt int, made string, shape string")

    real = entities.select("kind", F.col("form").alias("made"), F.lit(True).alias("real"))
    current = persisted(draw(entities.select("kind", "form", F.lit(0).alias("attempt"))), "surrogates")
    while True:
        shared = current.groupBy("kind", "made").agg(F.count("*").alias("n"), F.min(F.struct(-F.col("attempt"), "form")).alias("first"))
        clash = shared.join(real, ["kind", "made"], "left").filter("n > 1 or real")
        again = current.filter(F.col("attempt") != PLAIN).join(clash, ["kind", "made"])
        again = persisted(again.filter("real or form <> first.form").select("kind", "form", "attempt", "shape"), "clashes")
        if again.isEmpty():
            return current
        # the permutation of the whole shape clashes with no other shape, as surrogates keep theirs
        full = again.filter((F.col("attempt") + 1 >= ATTEMPTS) & (F.col("shape") != "")).select("kind", "shape").distinct()
        full = bounded(persisted(full, "full-shapes"))
        plain = current.join(full, ["kind", "shape"], "left_semi").withColumn("attempt", F.lit(PLAIN))
        more = again.join(full, ["kind", "shape"], "left_anti").withColumn("attempt", F.col("attempt") + 1)
        new = plain.select("kind", "form", "attempt").unionByName(more.select("kind", "form", "attempt"))
        kept = current.join(full, ["kind", "shape"], "left_anti").join(again.select("kind", "form"), ["kind", "form"], "left_anti")
        current = persisted(kept.unionByName(draw(new)), "surrogates")


def _rewrite(key: bytes, known: dict | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(…, text, entities drawn again) -> (…, text, counts by kind)."""
    for batch in slices(batches, text=2, most=SLICE):
        *rest, texts, special = batch.columns
        out, counts = [], []
        for text, own in zip(texts.to_pylist(), special.to_pylist(), strict=True):
            found = detect(text) if text else []
            counts.append([sum(k == kind for _, _, k, _ in found) for kind in KINDS])
            if not found:
                out.append(text)
                continue
            drawn = known if own is None else {(x["kind"], x["form"]): x["attempt"] for x in own}
            places = [0, *(x for s, e, _, _ in found for x in (s, e)), len(text)]
            parts = [text[a:b] for a, b in pairwise(places)]
            for k, (_, _, kind, form) in enumerate(found):
                attempt = (drawn or {}).get((kind, form), 0)
                parts[2 * k + 1] = render(parts[2 * k + 1], kind, surrogate(kind, form, attempt, key))
            out.append("".join(parts))
        names = [*batch.schema.names[:-1], *(f"n_{k}" for k in KINDS)]
        columns = [*rest, pa.array(out, texts.type), *(pa.array(c, pa.int32()) for c in zip(*counts, strict=True))]
        if not counts:
            columns = [*rest, texts, *(pa.array([], pa.int32()) for _ in KINDS)]
        yield pa.RecordBatch.from_arrays(columns, names)


def replaced(
    docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST
) -> DataFrame:
    """doc_id, the text with surrogates, and how many entities of each kind it held (n_email, …)."""
    return _replaced(docs, key, id_col, text_col, most, []).select("doc_id", "text", *(f"n_{k}" for k in KINDS))


def _replaced(docs: DataFrame, key: bytes, id_col: str, text_col: str, most: int, rest: list[str]) -> DataFrame:
    """As replaced(), with the columns ``rest`` in a struct ``row`` beside."""
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)]).alias("row")
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), row, F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    found = narrow.select("doc_id", "text").mapInArrow(_found, f"doc_id {kind}, kind string, form string")
    found = persisted(found, "entities")
    entities = persisted(found.select("kind", "form").distinct(), "distinct")
    again = persisted(assign(entities, key).filter("attempt <> 0").select("kind", "form", "attempt"), "again")
    special = "array<struct<kind string, form string, attempt int>>"
    if again.limit(most + 1).count() <= most:
        known = {(r["kind"], r["form"]): r["attempt"] for r in again.collect()}
        rows = narrow.withColumn("special", F.lit(None).cast(special))
    else:
        known = {}
        own = found.join(again, ["kind", "form"]).groupBy("doc_id")
        own = own.agg(F.collect_set(F.struct("kind", "form", "attempt")).alias("special"))
        rows = narrow.join(own, narrow.doc_id.eqNullSafe(own.doc_id), "left").drop(own.doc_id)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    rows = rows.select("doc_id", "row", "text", "special")
    out = StructType([*rows.schema.fields[:3], *(StructField(f"n_{k}", IntegerType()) for k in KINDS)])
    return rows.mapInArrow(lambda b: _rewrite(key, shared.value, b), out)


def with_surrogates(
    docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST
) -> DataFrame:
    """The documents with all their columns and surrogates in the text; n_chars, if there, follows the text."""
    rest = [c for c in docs.columns if c != text_col]
    out = _replaced(docs, key, id_col, text_col, most, rest)
    new = {c: F.col(f"row.c{k}") for k, c in enumerate(rest)} | {text_col: F.col("text")}
    if "n_chars" in rest:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new[c].alias(c) for c in docs.columns])
