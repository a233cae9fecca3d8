"""Surrogates for personal data.

Detected entities are e-mail addresses, telephone numbers, payment card numbers that pass the Luhn
test, IPv4 addresses, social security numbers, and names after a form of address, with all further
mentions of their parts in the same text (whole words with a capital; initials before a name). The
parts of a name are entities of their own, so that any form of a name gets the same surrogates.
Telephone numbers are those with ``+`` and 8 to 15 digits, those of 3-3-4 digits, and those that
start with 0 and have 9 to 14 digits in groups; country code and leading 0 stay. An entity is
brought to one spelling, its characters are read as digits of a number in mixed radix (vowels,
consonants, digits and other letters each stay in their class), and this number is moved by a keyed
permutation of its range. So a surrogate has the format, the script, the case and the length of
what it replaces, names keep their form of address, cards still pass the Luhn test. A part of a name
that is in one of the lists of names becomes another name of this list, by a keyed permutation of its
places: a woman's name a woman's, a man's a man's, a surname a surname, in the same script. Other parts
of names become other letters and keep the last one, by which gender shows. Equal entities get equal surrogates in all documents, different ones of a
kind get different ones, and none stays what it was, as the permutation has no fixed point (only a
range of one value cannot move).

No table of entities is needed to replace them, so replacing is one pass with no shuffle. As a
check the distinct entities are collected as a distributed table of keyed hashes, and any two
that met in one surrogate would be given another key, round after round, until none do.

Null texts stay null, empty ones empty, an empty table gives an empty one. Texts of any length are
rewritten whole, one at a time; texts without entities are not changed, repeated rows are changed
alike. ``n_chars`` is set anew for changed texts where the table has it. Other columns are kept as
they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import scratch

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# Forms of address, male and female.
_ADDRESS = r"(?:Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sra)"
_GAP = r"[ \u00a0./\u2011\u2013-]"
_PHONES = (
    r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|(?<!\d)\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
    rf"\+[1-9](?:{_GAP}?\(?\d\)?){{7,14}}(?!\d)",
    # after a leading 0: no date, no social security number
    r"(?<![.,/-])(?!\d\d[/-]\d\d[/-](?:19|20)\d\d(?!\d))(?!\d{3}-\d{2}-\d{4}(?![\d-]))(?=(?:[ ()/-]{0,3}\d){9})\(?0\d{1,4}\)?[ /-]{1,3}\d(?:[ /-]?\d){3,9}(?![ /-]?\d)",
    r"(?<![.,/-])0\d(?:\.\d\d){4}(?!\.?\d)",
)
_DETECT = re.compile(
    r"(?P<email>[\w.%+-]*[\w%+-]@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,})"
    rf"|(?P<phone>(?<![\w+])(?:{'|'.join(_PHONES)}))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d))"
    rf"|(?P<ip>(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d))"
    rf"|(?P<person>\b{_ADDRESS}\b\.?[ ]+(?:[^\W\d_a-z]\.[ ]?)*(?:[^\W\d_a-z](?:[^\W\d_]+|(?='))(?:[ '-](?=[^\W\d_a-z]))?)+)",
)
# Names by script, by women, men and families, in lower case. No name is in two lists; families with forms of their own for women have two lists in one order.
NAMES = {
    "latin women": "anna maria laura julia sophie emma clara elena lucia carmen isabel marta claire camille chloe manon emily sarah hannah katharina monika petra sabine teresa".split(),
    "latin men": "john james peter paul thomas michael david robert hans karl klaus stefan jürgen wolfgang pierre jean louis antoine carlos juan pedro miguel diego javier".split(),
    "latin families": "smith jones brown taylor walker müller schmidt weber fischer wagner becker hoffmann keller garcia lopez martinez sanchez fernandez dupont durand bernard moreau lefevre rousseau".split(),
    "cyrillic women": "анна мария елена ольга наталья татьяна ирина светлана екатерина людмила галина вера".split(),
    "cyrillic men": "иван сергей дмитрий андрей алексей михаил николай павел виктор юрий олег борис".split(),
    "cyrillic families, men": "иванов петров сидоров смирнов кузнецов попов соколов лебедев козлов новиков морозов волков".split(),
    "cyrillic families, women": "иванова петрова сидорова смирнова кузнецова попова соколова лебедева козлова новикова морозова волкова".split(),
}
_LISTED = {name: (kind, place) for kind, names in NAMES.items() for place, name in enumerate(names)}
KINDS = ("email", "phone", "ssn", "card", "ip", "person")
_TITLE = re.compile(rf"{_ADDRESS}\b\.?[ ]+")
#: A text without any of these has no entity.
_HINT = re.compile(rf"@|\+\d|\d{{3}}[ .-]?\d|\d\.\d|0\d{{1,4}}\)?[ /-]|\b{_ADDRESS}\b")
_LETTERS = re.compile(r"[^\W\d_]+")
# Country codes of one and of two digits; all others have three.
_CODE = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")
_NANP = re.compile(_PHONES[0])


def folded(text: str) -> str:
    """Lower case, letter by letter."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def parts(name: str) -> list[tuple[int, int]]:
    """Start and end of the parts of a name; what a single letter and an apostrophe put before one (O') stays."""
    return [m.span() for m in _LETTERS.finditer(name) if m.end() - m.start() > 1 or name[m.end() : m.end() + 1] != "'"]


def national(found: str) -> str:
    """The digits of a telephone number without country code and leading 0."""
    digits = re.sub(r"\D", "", found)
    if _NANP.fullmatch(found):
        return digits[-10:]
    if found[0] == "+" or digits.startswith("00"):
        digits = digits.removeprefix("00") if found[0] != "+" else digits
        digits = digits[_CODE.match(digits).end() :]
    return digits.removeprefix("0")


def luhn(digits: str) -> int:
    """The check digit that belongs after ``digits``."""
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 if n % 2 else 2)
        total += d - 9 * (d > 9)
    return -total % 10


class Permutation:
    """Keyed permutations of ranges: a Feistel network, with values outside the range sent on."""

    ROUNDS = 6

    def __init__(self, key: bytes):
        self.key = key

    def _hash(self, *parts) -> int:
        return int.from_bytes(hashlib.blake2b(repr(parts).encode(), key=self.key, digest_size=32).digest(), "big")

    def _network(self, x: int, bits: int, tweak: str, rounds) -> int:
        half = bits // 2
        mask = (1 << half) - 1
        a, b = x >> half, x & mask
        for r in rounds:
            if r % 2:
                a ^= self._wide(r, b, tweak, half)
            else:
                b ^= self._wide(r, a, tweak, half)
        return (a << half) | b

    def _wide(self, r: int, x: int, tweak: str, half: int) -> int:
        out, have = 0, 0
        while have < half:
            out, have = (out << 256) | self._hash("round", r, have, x, tweak, half), have + 256
        return out >> (have - half)

    def move(self, x: int, n: int, tweak: str) -> int:
        """Without a fixed point if ``n`` > 1: back(forth(x) + shift)."""
        if n < 2:
            return x
        bits = max(2, (n - 1).bit_length())
        bits += bits % 2
        forth, back = range(self.ROUNDS), range(self.ROUNDS - 1, -1, -1)

        def walk(v: int, rounds) -> int:
            v = self._network(v, bits, tweak, rounds)
            while v >= n:
                v = self._network(v, bits, tweak, rounds)
            return v

        shift = 1 + self._hash("shift", n, tweak) % (n - 1)
        return walk((walk(x, forth) + shift) % n, back)


_PLAIN = ("0123456789", "aeiou", "AEIOU", "bcdfghjklmnpqrstvwxyz", "BCDFGHJKLMNPQRSTVWXYZ", "".join(map(chr, range(0x410, 0x430))), "".join(map(chr, range(0x430, 0x450))))


@lru_cache(maxsize=65_536)
def _alphabet(c: str) -> str:
    """The characters that may stand for ``c``: its own class; empty for signs, which stay.

    The classes share no character, so that a surrogate's classes are those of what it replaces.
    Beyond the plain ones a class holds the letters of a block of 128 that have the same category.
    """
    for alphabet in _PLAIN:
        if c in alphabet:
            return alphabet
    category = unicodedata.category(c)
    if category[0] != "L" or ord(c) < 128:
        return ""
    # letters whose case has another length, or does not come back, form no class and stay
    settled = lambda x: len(x.lower()) == len(x.upper()) == 1 and x.upper().lower() == x.lower()
    block = map(chr, range(ord(c) & ~0x7F, (ord(c) & ~0x7F) + 128))
    same = [x for x in block if unicodedata.category(x) == category and settled(x) and not any(x in a for a in _PLAIN)]
    return "".join(same) if settled(c) else ""


class Surrogates:
    """``again``: (kind, keyed hash) of entities to the number of the key they are given instead."""

    def __init__(self, key: bytes, again: dict[tuple[str, str], int] | None = None):
        self.move = Permutation(hashlib.blake2b(key, digest_size=32).digest()).move
        self.key, self.again = key, again or {}
        self.known: dict[tuple[str, str], str] = {}

    def _letters(self, text: str, free: list[int], tweak: str) -> str:
        """Move the characters of ``text`` at ``free``; those without a class stay."""
        sets = [(i, a) for i in free if len(a := _alphabet(text[i])) > 1 and text[i] in a]
        value = size = 0
        size = 1
        for i, a in sets:
            value, size = value * len(a) + a.index(text[i]), size * len(a)
        shape = [a[0] for _, a in sets]
        value = self.move(value, size, f"{tweak} {''.join(shape)} {len(text)}")
        out = list(text)
        for i, a in reversed(sets):
            value, k = divmod(value, len(a))
            out[i] = a[k]
        return "".join(out)

    @staticmethod
    def one_spelling(kind: str, found: str) -> str:
        """What makes two mentions the same entity; of a person it is for one part of the name."""
        if kind in ("email", "person"):
            return folded(found)
        if kind == "phone":
            return national(found)
        return re.sub(r"\D", "", found) if kind in ("card", "ssn") else found

    @classmethod
    def spellings(cls, kind: str, found: str) -> list[str]:
        """The entities of a mention: for a person one for each part of the name."""
        if kind != "person":
            return [cls.one_spelling(kind, found)]
        name = found[cls._start(found) :]
        return [cls.one_spelling(kind, name[s:e]) for s, e in parts(name)]

    @staticmethod
    def _start(found: str) -> int:
        """Where the name begins, after a form of address."""
        title = _TITLE.match(found)
        return title.end() if title else 0

    def hashed(self, kind: str, entity: str) -> str:
        return hashlib.blake2b(f"{kind} {entity}".encode(), key=self.key[:64], digest_size=16).hexdigest()

    def of_entity(self, kind: str, entity: str) -> str:
        found = self.known.get((kind, entity))
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            tweak = kind
            if self.again and (n := self.again.get((kind, self.hashed(kind, entity)))):
                tweak = f"{kind} {n}"
            found = self.known[kind, entity] = self._new(kind, entity, tweak)
        return found

    def _new(self, kind: str, x: str, tweak: str) -> str:
        if kind == "email":
            local, _, domain = x.rpartition("@")
            labels = domain.split(".")
            reserved = labels[-2] == "example" or labels[-1] in ("example", "test", "invalid")
            free = len(local) + 1 + len(".".join(labels[: -2 if reserved and len(labels) > 2 else -1]))
            at = [i for i in range(min(free, len(x))) if i < len(local) or not reserved or len(labels) > 2]
            return self._letters(x, at, tweak)
        if kind == "phone":
            # 555 marks numbers that belong to nobody, and stays
            marked = len(x) == 10 and x[3:6] == "555"
            return self._letters(x, [i for i in range(len(x)) if not marked or not 3 <= i < 6], tweak)
        if kind == "card":
            body = self._letters(x[:-1], list(range(1, len(x) - 1)), tweak)
            return body + str(luhn(body))
        if kind == "ip":
            value = 0
            for part in x.split("."):
                value = value * 256 + int(part)
            value = self.move(value, 1 << 32, tweak)
            return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))
        if kind == "person" and x in _LISTED:
            of, place = _LISTED[x]
            return NAMES[of][self.move(place, len(NAMES[of]), f"{tweak} {of.partition(',')[0]}")]
        if kind == "person":
            return self._letters(x, list(range(max(1, len(x) - 1))), tweak)
        return self._letters(x, list(range(len(x))), tweak)

    def replacement(self, kind: str, found: str) -> str:
        """The surrogate in the spelling of the mention."""
        if kind == "person":
            start, out, at = self._start(found), [], 0
            for s, e in parts(found[start:]):
                out += [found[at : start + s], self._cased(kind, found[start + s : start + e])]
                at = start + e
            return "".join([*out, found[at:]])
        if kind == "email":
            return self._cased(kind, found)
        entity = self.one_spelling(kind, found)
        other = self.of_entity(kind, entity)
        if kind == "ip":
            return other
        digits = iter(other)
        skip = sum(c.isdigit() for c in found) - len(other)
        out = []
        for c in found:
            if c.isdigit() and skip:
                skip -= 1
            elif c.isdigit():
                c = next(digits)
            out.append(c)
        return "".join(out)

    def _cased(self, kind: str, found: str) -> str:
        entity = self.one_spelling(kind, found)
        if kind == "person" and entity in _LISTED:  # of another length
            other = self.of_entity(kind, entity)
            return other.upper() if found.isupper() else other.capitalize() if found[0].isupper() else other
        return "".join(o.upper() if c != e and len(o.upper()) == 1 else o for c, e, o in zip(found, entity, self.of_entity(kind, entity), strict=True))

    def entities(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end), from left to right."""
        if not _HINT.search(text):
            return []
        out = []
        for m in _DETECT.finditer(text):
            kind = m.lastgroup
            if kind == "card":
                digits = re.sub(r"\D", "", m[0])
                if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
                    continue
            out.append((kind, m.start(), m.end()))
        names = {x for kind, s, e in out if kind == "person" for x in self.spellings(kind, text[s:e])}
        return sorted([*out, *self._again(text, names, out)], key=lambda x: x[1]) if names else out

    def _again(self, text: str, names: set[str], found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Mentions of ``names`` outside of ``found``; neighbours are one mention."""
        out: list[tuple[str, int, int]] = []
        taken, initials, last = iter([*found, ("", len(text), len(text))]), [], 0
        _, a, b = next(taken)
        for m in _LETTERS.finditer(text):
            s, e = m.span()
            while b <= s:
                _, a, b = next(taken)
            if e > a or text[s].islower() or folded(m[0]) not in names:
                continue
            if e - s == 1:  # an initial counts only before a name
                if text[e : e + 1] == ".":
                    initials = [*initials, (s, e)] if initials and text[initials[-1][1] : s].strip(". ") == "" else [(s, e)]
                continue
            if initials and text[initials[-1][1] : s] in (".", ". "):
                s = initials[0][0]
            initials = []
            if out and s >= last and (text[last:s] in ("-", "'") or text[last:s].strip(" ") == ""):
                out[-1] = ("person", out[-1][1], e)
            else:
                out.append(("person", s, e))
            last = e
        return out

    def rewrite(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        found = self.entities(text)
        out, at = [], 0
        for kind, s, e in found:
            out += [text[at:s], self.replacement(kind, text[s:e])]
            at = e
        return "".join([*out, text[at:]]), found


def collisions(docs: DataFrame, key: bytes, again: dict[tuple[str, str], int], text: str = "text") -> list[tuple[str, str]]:
    """(kind, keyed hash) of entities whose surrogate another entity of the kind has too, but for one of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Surrogates(key, again)
        for x in batches:
            rows = set()
            for t in x["body"]:
                for kind, s, e in own.entities(t):
                    for entity in own.spellings(kind, t[s:e]):
                        rows.add((kind, own.hashed(kind, entity), own.hashed(kind, own.of_entity(kind, entity))))
            yield pd.DataFrame(sorted(rows), columns=["kind", "entity", "surrogate"])

    body = F.coalesce(F.col(text), F.lit(""))
    met = docs.select(body.alias("body")).mapInPandas(run, "kind string, entity string, surrogate string").distinct()
    met = scratch.materialize(met, "entities")  # read twice, found once
    clash = met.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min("entity").alias("first")).where("n > 1").select("kind", "surrogate", "first")
    # by construction none; the bound is a guard
    rows = met.join(clash, ["kind", "surrogate"]).where("entity <> first").select("kind", "entity").limit(100_000).collect()
    scratch.drop(met)
    return [(r.kind, r.entity) for r in rows]


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", rounds: int = 8, name: str = "pii") -> DataFrame:
    """``docs`` with surrogates in ``text``, and the column ``name``: kind, start and end of each entity as it was."""
    scratch.limit_batches(docs.sparkSession)
    again: dict[tuple[str, str], int] = {}
    for n in range(1, rounds + 1):
        met = collisions(docs, key, again, text)
        if not met:
            break
        again.update(dict.fromkeys(met, n))
    else:
        raise RuntimeError("surrogates still collide")

    @F.pandas_udf("text string, pii array<struct<kind:string,start:int,end:int>>")
    def rewritten(bodies: pd.Series) -> pd.DataFrame:
        own = Surrogates(key, again)
        rows = [(None, []) if t is None else own.rewrite(t) for t in bodies]
        return pd.DataFrame({"text": [r[0] for r in rows], "pii": [[{"kind": k, "start": s, "end": e} for k, s, e in r[1]] for r in rows]})

    if name in docs.columns:
        raise ValueError(f"the table has a column {name} of its own: give another name")
    new = scratch.unused(docs, "new")
    out = docs.withColumn(new, rewritten(F.col(text)))
    keep = {c: F.col(f"`{c}`") for c in docs.columns} | {text: F.col(f"{new}.text")}
    if "n_chars" in keep:
        keep["n_chars"] = F.when(F.size(f"{new}.pii") > 0, F.length(f"{new}.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[keep[c].alias(c) for c in docs.columns], F.col(f"{new}.pii").alias(name))


def surrogate_report(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with surrogates, n_entities and the number of each kind."""
    out = pseudonymise(docs.select("doc_id", "text"), key)
    return out.select(
        "doc_id", "text", F.size("pii").cast("long").alias("n_entities"), *[F.size(F.filter("pii", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    )


def _is(kind: str):
    return lambda x: x.kind == kind
