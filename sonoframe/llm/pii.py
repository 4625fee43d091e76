"""Surrogates for personal data.

Entities are found in whole texts: mail addresses, phone numbers, payment cards (with a valid check digit), IPv4
addresses, IBANs (with valid check digits), US social security numbers, and names of persons (a title or a known given
name before capitalised words). Each gets a replacement drawn from a keyed hash of its kind and canonical form, so the
same entity gets the same one everywhere, however it is written. Replacements keep the kind's format: separators, case,
number of characters, country code, check digits; for names the script, and the gender of given names. A name is
replaced word by word, so "Anna Weber" and "Frau Weber" still share a surname.

A replacement may equal neither another one of its kind nor any entity of its kind in the corpus. Entities for
which the first draw does draw again, until none clashes; drawings that aren't the first are the only thing
that replacing has to look up, and they travel by document.

Defined results: a null text stays null; texts without entities come back as they are; spans don't overlap, the earlier
kind in the order above wins; rows that share a doc_id, or have none, are replaced alike; repeated rows get equal
results; an empty table gives no rows. Other columns are ignored. Intermediate tables hold entities in clear until
the replacements are drawn: the shared folder needs the protection that the corpus has.
"""

from __future__ import annotations

import hashlib
import hmac
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonoframe.llm.common import scratch, settle, small

# Given names and titles, by gender and script.
GIVEN = {
    ("f", "latin"): "Alice Amelia Anna Barbara Camille Carla Carmen Claire Clara Elena Elizabeth Emily Emma Eva Hannah Ines Isabel "
    "Jennifer Julia Karen Laura Lena Linda Louise Lucia Maria Marie Mary Patricia Sarah Sofia Sophie Susan",
    ("m", "latin"): "Alexander Andreas Antonio Carlos Charles Daniel David Diego Felix Hans Hugo James Jean John Jonas Juan Karl "
    "Louis Lucas Manuel Mark Martin Michael Miguel Pablo Paul Peter Pierre Richard Robert Stefan Thomas William",
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Наталья Ольга Светлана Татьяна",
    ("m", "cyrillic"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей",
}
TITLES = {
    "f": "Mrs Ms Miss Frau Señora Sra Madame Mme Mlle",
    "m": "Mr Herr Señor Sr Monsieur",
    "": "Dr Prof Professor Doctor",
}
#: Syllables that surnames are made of.
SYLLABLES = {
    "latin": "bal bren cor dan del far gor hal ker lan mar mel nor pel ran sal tor val wen zel".split(),
    "cyrillic": "бар вол гор дор ким лаз мар нор пол рев сол тар".split(),
}
GENDER_OF = {name: gender for (gender, _), names in GIVEN.items() for name in names.split()}
TITLE_OF = {title: gender for gender, titles in TITLES.items() for title in titles.split()}

_AT_LEFT = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@((?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,})")
_DIGITS = re.compile(r"[+(]?\d[\d ()./-]*\d")
_IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")
_SSN = re.compile(r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])")
#: Groups of digits of which some may be a card; the last is not the whole part of a decimal number.
_CARD_GROUPS = re.compile(r"(?<![\d.-])\d+(?:[ -]\d+)*(?!\d|\.\d)")
#: Numbers as issuers give them out. Where valid numbers overlap these are taken first; others count too.
_ISSUED = re.compile(r"4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]|2[2-7])\d{14}|3[47]\d{13}|3(?:0|6|8|9)\d{12,17}|35\d{14,17}|6\d{15,18}")
_PHONE = re.compile(
    r"(?<![\w.(-])(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w]|[.-]\d)"
)
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?= ?[A-Z0-9]{4})")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_UPPER = "A-ZÀ-ÖØ-ÞА-ЯЁ"
_WORD = rf"[{_UPPER}][a-zß-öø-ÿа-яё]+(?:[-'’][{_UPPER}]?[a-zß-öø-ÿа-яё]+)*"
_NAMED = re.compile(rf"({_WORD})(\.?)((?: {_WORD})+)")


def luhn_valid(digits: str) -> bool:
    total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _iban_check(country: str, rest: str) -> str:
    number = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{98 - number % 97:02d}"


def _cards(text: str, low: int, high: int) -> list[tuple[int, int, str]]:
    """(start, end, digits) of payment cards: runs of whole groups with 13 to 19 digits and a valid check digit."""
    out: list[tuple[int, int, str]] = []
    for run in _CARD_GROUPS.finditer(text, low, high):
        if run.end() - run.start() < 13:
            continue
        groups = [(m.start(), m.end()) for m in re.finditer(r"\d+", run[0])]
        valid = []
        for k, (start, _) in enumerate(groups):
            digits = ""
            for a, b in groups[k:]:
                digits += run[0][a:b]
                if len(digits) > 19:
                    break
                if len(digits) >= 13 and luhn_valid(digits):
                    valid.append((not _ISSUED.fullmatch(digits), -len(digits), start, b, digits))
        taken: list[tuple[int, int, str]] = []
        for _, _, start, end, digits in sorted(valid):
            if all(end <= a or b <= start for a, b, _ in taken):
                taken.append((start, end, digits))
        out += sorted((run.start() + a, run.start() + b, digits) for a, b, digits in taken)
    return out


def _outside(pattern: re.Pattern, text: str, low: int, high: int, cards: list[tuple[int, int, str]]):
    """Matches before, between and after cards."""
    for start, end, _ in [*cards, (high, high, "")]:
        yield from pattern.finditer(text, low, start)
        low = end


def _ibans(text: str):
    """(start, end, plain form) of IBANs; of the groups that follow a head the most that have valid check digits."""
    last = 0
    for head in _IBAN_HEAD.finditer(text):
        match = _IBAN.match(text, head.start()) if head.start() >= last else None
        if not match:
            continue
        ends = [match.end(), *(match.start() + k for k in range(len(match[0]) - 1, 0, -1) if match[0][k] == " ")]
        for end in ends:
            plain = text[match.start() : end].replace(" ", "")
            if 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                yield match.start(), end, plain
                last = end
                break


def _names(text: str):
    match = _NAMED.search(text)
    while match:
        first, words = match[1], match[3][1:].split(" ")
        title = TITLE_OF.get(first)
        if title is None:
            if match[2] or first not in GENDER_OF:
                match = _NAMED.search(text, match.end(1))
                continue
            words = [first, *words]
            at = match.start(1)
        else:
            at = match.start(3) + 1
        # The next title begins the next person; a given name after a surname does so by itself.
        words = words[: next((k for k, word in enumerate(words) if word in TITLE_OF), len(words))]
        for k, word in enumerate(words):
            gender = GENDER_OF.get(word)
            # The last word of several is a surname, whatever else it may be.
            given = gender is not None and (k < len(words) - 1 or k == 0 and title is None)
            yield at, at + len(word), f"given_{gender}" if given else "surname", word
            at += len(word) + 1
        match = _NAMED.search(text, at - 1 if words else at)


def find_entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities, in order."""
    found: list[tuple[int, int, str, str]] = []
    at = text.find("@")
    while at >= 0:
        start = at
        while start and text[start - 1] in _AT_LEFT:
            start -= 1
        while start < at and text[start] in ".%+-":
            start += 1
        match = _DOMAIN.match(text, at)
        if match and start < at:
            found.append((start, match.end(), "mail", text[start : match.end()].lower()))
        at = text.find("@", at + 1)
    for run in _DIGITS.finditer(text):
        if run.end() - run.start() < 7:
            continue
        low, high = max(0, run.start() - 3), min(len(text), run.end() + 3)
        cards = _cards(text, low, high)
        found += [(start, end, "card", digits) for start, end, digits in cards]
        issued = [c for c in cards if _ISSUED.fullmatch(c[2])]
        for kind, pattern in (("ip", _IP), ("ssn", _SSN), ("phone", _PHONE)):
            for match in _outside(pattern, text, low, high, issued):
                digits = re.sub(r"\D", "", match[0])
                if kind == "phone":
                    if not 8 <= len(digits) <= 15:
                        continue
                    digits = digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
                found.append((match.start(), match.end(), kind, match[0] if kind == "ip" else digits))
    found += [(start, end, "iban", plain) for start, end, plain in _ibans(text)]
    found += _names(text)
    order = {k: i for i, k in enumerate(("mail", "ip", "ssn", "card", "phone", "iban"))}
    found.sort(key=lambda e: (e[0], order.get(e[2], 9), -e[1]))
    out: list[tuple[int, int, str, str]] = []
    for entity in found:
        if not out or entity[0] >= out[-1][1]:
            out.append(entity)
    return out


class _Draw:
    """A stream of choices from a keyed hash."""

    def __init__(self, key: bytes, *parts: str) -> None:
        self.state, self.pool = hmac.digest(key, "\0".join(parts).encode(), "sha256"), 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < n << 16:
            self.state = hmac.digest(self.state, b"more", "sha256")
            self.pool, self.left = int.from_bytes(self.state, "big"), 1 << 256
        self.pool, value = divmod(self.pool, n)
        self.left //= n
        return value

    def like(self, text: str, keep: int = 0) -> str:
        """A text of the same shape; the first `keep` characters stay."""
        out = list(text[:keep])
        for c in text[keep:]:
            if c.isdigit():
                out.append(chr(48 + self.below(10)))
            elif "a" <= c <= "z" or "A" <= c <= "Z":
                out.append(chr((97 if c.islower() else 65) + self.below(26)))
            else:
                out.append(c)
        return "".join(out)


def surrogate(key: bytes, kind: str, canon: str, attempt: int) -> str:
    """Canonical form of an entity's replacement."""
    if kind == "mail":
        local, _, domain = canon.partition("@")
        name, _, top = domain.rpartition(".")
        # The domain is drawn alone, so that addresses of one domain still share one.
        draw = _Draw(key, kind, local, domain, str(attempt))
        extra = "".join(chr(97 + draw.below(26)) for _ in range(max(0, attempt - 3)))
        return f"{draw.like(local)}{extra}@{_Draw(key, 'domain', domain).like(name)}.{top}"
    draw = _Draw(key, kind, canon, str(attempt))
    if kind == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "ssn":
        return f"{1 + draw.below(665):03d}{1 + draw.below(99):02d}{1 + draw.below(9999):04d}"
    if kind == "card":
        body = draw.like(canon[:-1], keep=1)
        return next(body + str(d) for d in range(10) if luhn_valid(body + str(d)))
    if kind == "phone":
        return draw.like(canon, keep=max(0, len(canon) - 9) if len(canon) > 10 else 0)
    if kind == "iban":
        rest = draw.like(canon[4:])
        return canon[:2] + _iban_check(canon[:2], rest) + rest
    script = "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in canon) else "latin"
    if kind.startswith("given_"):
        names = GIVEN[kind[-1], script].split()
        name = names[draw.below(len(names))]
        # A second given name keeps further drawings distinct once the list is used up.
        return name if attempt < 4 else name + "".join(SYLLABLES[script][draw.below(len(SYLLABLES[script]))] for _ in range(attempt - 2))
    parts = SYLLABLES[script]
    return "".join(parts[draw.below(len(parts))] for _ in range(3 + attempt // 3)).capitalize()


def render(kind: str, original: str, canon: str, replaced: str) -> str:
    """The replacement written as the original is."""
    if kind in ("phone", "card", "ssn", "iban"):
        plain = iter(replaced)
        chars = [c for c in original]
        wanted = [k for k, c in enumerate(chars) if c.isalnum()]
        skip = len(wanted) - len(replaced)
        for k in wanted[skip:]:
            chars[k] = next(plain)
        return "".join(chars)
    if kind == "mail":
        return replaced.upper() if original.isupper() else replaced
    return replaced


def _mention_worker(batches):
    for batch in batches:
        ids, kinds, canons = [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for kind, canon in sorted({(e[2], e[3]) for e in find_entities(text or "")}):
                ids.append(doc_id)
                kinds.append(kind)
                canons.append(canon)
        yield pa.RecordBatch.from_pydict(
            {"doc_id": pa.array(ids, pa.int64()), "kind": pa.array(kinds, pa.string()), "canon": pa.array(canons, pa.string())}
        )


def _draw_worker(key: bytes):
    def run(batches):
        for batch in batches:
            kinds, canons, tries = (batch.column(k).to_pylist() for k in range(3))
            made = [surrogate(key, *row) for row in zip(kinds, canons, tries, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], ["kind", "canon", "attempt", "drawn"])

    return run


def keyed_name(key: bytes, canon: str) -> str:
    """Stands for an entity in tables that outlive the job that made them."""
    return hashlib.sha256(key + b"\0" + canon.encode()).hexdigest()


def _replace_worker(key: bytes):
    def run(batches):
        known: dict[tuple[str, str, int], str] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts, counts = [], []
                for text, later in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    tries = {(o["kind"], o["named"]): o["attempt"] for o in later or ()}
                    entities = find_entities(text or "")
                    pieces, last = [], 0
                    for start, end, kind, canon in entities:
                        name = (kind, canon, tries.get((kind, keyed_name(key, canon)), 0) if tries else 0)
                        if name not in known:
                            if len(known) > 100_000:
                                known.clear()
                            known[name] = surrogate(key, *name)
                        pieces += [text[last:start], render(kind, text[start:end], canon, known[name])]
                        last = end
                    texts.append("".join([*pieces, text[last:]]) if entities else text)
                    counts.append(len(entities))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["doc_id", "text", "n_entities"]
                )

    return run


def attempts(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, canon, attempt of entities (kind, canon) whose first draw clashes; the rest keep attempt 0."""
    schema = "kind string, canon string, attempt int, drawn string"
    draw = lambda rows: settle(rows.mapInArrow(_draw_worker(key), schema), "pii-draws")
    drawn = draw(entities.select("kind", "canon", F.lit(0).alias("attempt")))
    while True:
        # Of equal draws the earliest drawing keeps it, then the least entity; none may be an entity itself.
        rank = F.row_number().over(Window.partitionBy("kind", "drawn").orderBy("attempt", "canon"))
        real = entities.select("kind", F.col("canon").alias("drawn"), F.lit(True).alias("real"))
        judged = drawn.withColumn("r", rank).join(real, ["kind", "drawn"], "left")
        judged = settle(
            judged.select("kind", "canon", "attempt", "drawn", ((F.col("r") > 1) | F.col("real").isNotNull()).alias("again")), "pii-judged"
        )
        again = judged.where("again")
        if again.isEmpty():
            return judged.where("attempt > 0").select("kind", "canon", "attempt")
        redrawn = draw(again.select("kind", "canon", (F.col("attempt") + 1).alias("attempt")))
        drawn = judged.where("not again").drop("again").unionByName(redrawn)


def with_surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with all entities replaced, n_entities."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with scratch(docs.sparkSession) as keep:
        mentions = settle(rows.mapInArrow(_mention_worker, "doc_id long, kind string, canon string"), "pii-mentions")
        later = attempts(settle(mentions.select("kind", "canon").distinct(), "pii-entities"), key)
        # The result reads this table later, so it stays, without the entities themselves.
        named = F.sha2(F.concat(F.unhex(F.lit((key + b"\0").hex())), F.encode("canon", "UTF-8")), 256)
        by_doc = (
            mentions.distinct()
            .join(later, ["kind", "canon"])
            .groupBy(F.col("doc_id").alias("later_id"))
            .agg(F.collect_list(F.struct("kind", named.alias("named"), "attempt")).alias("later"))
        )
        by_doc = keep(settle(by_doc, "pii-later"))
    joined = rows.join(small(by_doc), F.col("doc_id").eqNullSafe(F.col("later_id")), "left").select("doc_id", "text", "later")
    return joined.mapInArrow(_replace_worker(key), "doc_id long, text string, n_entities long")
