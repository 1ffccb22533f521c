"""Surrogates for personal data: keyed, of the same kind and form, different for different entities."""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import re
import secrets
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import BROADCAST_ROWS, give_back, materialize, read_table

#: The setting that has the key of the surrogates.
KEY_SETTING = "spark.tidewire.pii.key"
#: Rounds of giving colliding entities another surrogate; each leaves a tiny share of the last.
MAX_ATTEMPTS = 50
#: Syllables of a made surname; more on later attempts.
NAME_SYLLABLES = 4

#: Given names by script and gender.  A name maps to another of its own list.
GIVEN = {
    ("latin", "f"): "Alice Anna Barbara Carmen Catherine Charlotte Christine Claire Elena Elizabeth Emily Emma Frances Hannah Helen Ingrid Isabel Jennifer Jessica Julia Karen Katharina Laura Linda Lucia Margaret Maria Marie Martha Mary Nancy Olivia Patricia Rachel Sandra Sarah Sofia Susan Teresa Ursula Valentina Victoria",
    ("latin", "m"): "Alexander Andrew Anthony Antonio Benjamin Bernard Carlos Charles Christian Christopher Daniel David Dieter Edward Eric Francisco Frank George Gerhard Hans Henry Jacques James Jean Johannes John Joseph Juan Jürgen Klaus Louis Manuel Michael Miguel Patrick Paul Peter Philippe Pierre Richard Robert Stefan Thomas William Wolfgang",
    ("cyrillic", "f"): "Александра Анна Валентина Вера Галина Дарья Екатерина Елена Ирина Ксения Людмила Мария Наталья Ольга Светлана Татьяна",
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Владимир Дмитрий Иван Игорь Максим Михаил Николай Олег Павел Сергей Фёдор Юрий",
    ("greek", "f"): "Αικατερίνη Άννα Βασιλική Γεωργία Ειρήνη Ελένη Μαρία Σοφία",
    ("greek", "m"): "Αλέξανδρος Ανδρέας Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Νικόλαος Παύλος",
}
#: Words before a name, with the gender that they tell.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Dr": "", "Prof": "", "Herr": "m", "Frau": "f",
    "Monsieur": "m", "Madame": "f", "Señor": "m", "Señora": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f",
}
#: The syllables of made surnames, by script.
SYLLABLES = {
    "latin": "ba ber bo bra cor da del do dra el fa fen ga gor hal har jo ka kel lam len lo mar mel mo nor pa ras ro sel tan vel".split(),
    "cyrillic": "ба бер бо бра вол га гор да дол ер жу за зор ка кол ла лен ма мир но пе ра ров са сол та тор ук фе хо че ша".split(),
    "greek": "βα γα γρη δα δη ζα θα θε κα κο λα λε μα μι νι ξε πα πε ρα ρο σα στα τα τρι φι φω χα χρι ψα ωρ αν ελ".split(),
}
#: How surnames of families end by script, for a man and for a woman; the longest that fits counts.
#: What stands before the ending is the family's, so that both forms have one surrogate.
ENDINGS = {
    "latin": (),
    "cyrillic": (("ский", "ская"), ("цкий", "цкая"), ("ов", "ова"), ("ев", "ева"), ("ёв", "ёва"), ("ин", "ина"), ("ын", "ына")),
    "greek": (("όπουλος", "οπούλου"), ("ίδης", "ίδου"), ("άδης", "άδου"), ("άκης", "άκη"), ("ης", "η"), ("ος", "ου"), ("ας", "α")),
}

_GENDER = {name: (script, gender) for (script, gender), names in GIVEN.items() for name in names.split()}
_LISTS = {k: v.split() for k, v in GIVEN.items()}

_EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,24}(?![\w@])")
_DIGITS = re.compile(
    r"(?P<card>(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w.+-])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}"
    # E.164 with or without groups, then national numbers from their 0 on.
    r"|\+[1-9](?:[ .-]?\d|[ .-]?\(\d{1,4}\)){7,14}|0\d{1,4}[ /-]\d{5,8}|0\d(?:[ .-]\d{2}){4})(?![\w-]))"
)
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:]|\.\d)")
_CAPITALISED = re.compile(r"(?<!\w)[^\W\d_a-zа-яα-ω][\w'’-]*\w")
_HAS_DIGITS = re.compile(r"\d[\d .()-]{5,}\d")

Mention = tuple[str, str, int, int]


def _script(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 else "latin"


def normal_form(kind: str, raw: str) -> str:
    """What mentions of one entity share: emails in lower case, numbers as digits, surnames as their family's masculine form."""
    if kind == "email":
        return raw.lower()
    if kind == "given":
        return as_written(raw)
    if kind == "surname":
        return family_of(as_written(raw))[0]
    if kind == "iban":
        return raw.replace(" ", "")
    if kind == "ipv6":
        return ipaddress.IPv6Address(raw).exploded
    if kind in ("card", "ssn", "phone"):
        return ("+" if raw[0] == "+" else "") + re.sub(r"\D", "", raw)
    return str(ipaddress.IPv4Address(".".join(str(int(x)) for x in raw.split(".")))) if kind == "ip" else raw


def as_written(name: str) -> str:
    """A name in capitals only, of four letters or more, as it is written elsewhere."""
    return name.capitalize() if len(name) > 3 and name.isupper() and name.isalpha() else name


def family_of(surname: str) -> tuple[str, str]:
    """What a surname is without its gendered ending, in its masculine form, and its gender ("" where the form tells none)."""
    for endings in ENDINGS[_script(surname)]:
        for ending, gender in zip(endings, "mf"):
            if surname.endswith(ending) and len(surname) > len(ending) + 1:
                return surname[: -len(ending)] + endings[0], gender
    return surname, ""


def _without_possessive(m: re.Match) -> tuple[int, int, str]:
    """Start, end and word; a final 's stays in the text behind the name."""
    word = m[0][:-2] if m[0].endswith(("'s", "’s")) else m[0]
    return m.start(), m.start() + len(word), word


def _shouted(words: list[tuple[int, int, str]], i: int, text: str) -> bool:
    """A word in capitals with another such word before or behind it, names apart: then capitals tell no name."""
    def loud(j: int) -> bool:
        return 0 <= j < len(words) and words[j][2].isupper() and len(words[j][2]) > 1

    before = loud(i - 1) and text[words[i - 1][1] : words[i][0]] == " "
    return loud(i) and (before or loud(i + 2) and text[words[i + 1][1] : words[i + 2][0]] == " ")


def _names(text: str) -> list[Mention]:
    """Given names before a surname, names after titles, and later mentions of these families' surnames alone."""
    words = [_without_possessive(m) for m in _CAPITALISED.finditer(text)]
    plain = [as_written(w) for _, _, w in words]
    if not any(w in _GENDER or w in TITLES for w in plain):
        return []
    found: dict[int, Mention] = {}
    families: set[str] = set()

    def take(kind: str, i: int) -> None:
        a, b, w = words[i]
        found[a] = (kind, normal_form(kind, w), a, b)
        if kind == "surname":
            families.add(found[a][1])

    for i in range(len(words) - 1):
        gap = text[words[i][1] : words[i + 1][0]]
        w, after = plain[i], plain[i + 1]
        if after in TITLES or after in _GENDER or _shouted(words, i, text):
            continue
        if w in TITLES and gap in (" ", ". "):
            take("surname", i + 1)
        elif w in _GENDER and gap == " ":
            take("given", i)
            take("surname", i + 1)
    for i, (a, _, w) in enumerate(words):
        if a not in found and family_of(plain[i])[0] in families:
            take("surname", i)
    return list(found.values())


def _check_97(iban: str) -> int:
    """The remainder of an account number that tells whether its check digits are right: 1 if they are."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _numbered(text: str) -> list[Mention]:
    """Account numbers with right check digits, and addresses of 128 bits."""
    found: list[Mention] = []
    for m in _IBAN.finditer(text):
        if _check_97(m[0].replace(" ", "")) == 1:
            found.append(("iban", normal_form("iban", m[0]), *m.span()))
    if "::" in text or text.count(":") >= 7:
        for m in _IPV6.finditer(text):
            try:
                value = normal_form("ipv6", m[0])
            except ValueError:
                continue
            if any(c.isdigit() for c in m[0]) and len(m[0].replace(":", "")) >= 3:
                found.append(("ipv6", value, *m.span()))
    return found


def mentions(text: str | None) -> list[Mention]:
    """(kind, normal form, start, end) of personal data in a text, in order, without overlaps; emails win over numbers, numbers over names."""
    if not text:
        return []
    found: list[Mention] = []
    if "@" in text:
        found += [("email", normal_form("email", m[0]), *m.span()) for m in _EMAIL.finditer(text)]
    found += _numbered(text)
    if _HAS_DIGITS.search(text):
        found += [(m.lastgroup, normal_form(m.lastgroup, m[0]), *m.span()) for m in _DIGITS.finditer(text)]
    found += _names(text)
    out: list[Mention] = []
    starts: list[int] = []
    for m in found:
        # What is kept doesn't overlap, so only the neighbours by start can.
        at = bisect.bisect_left(starts, m[2])
        if (at == 0 or out[at - 1][3] <= m[2]) and (at == len(out) or m[3] <= out[at][2]):
            out.insert(at, m)
            starts.insert(at, m[2])
    return out


class Surrogates:
    """Keyed one-to-one maps of each kind onto itself; ``attempt`` above 0 gives an entity another surrogate."""

    def __init__(self, key: str, syllables: int = NAME_SYLLABLES):
        self._syllables = syllables
        self._key = hashlib.blake2b(key.encode(), digest_size=32).digest()
        self.of = lru_cache(200_000)(self._of)

    def _hash(self, *parts: object) -> int:
        data = "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")
        return int.from_bytes(hashlib.blake2b(data, key=self._key, digest_size=32).digest(), "big")

    def permute(self, x: int, n: int, *tweak: object) -> int:
        """A keyed permutation of the numbers below n: a Feistel network on enough bits, walked until it is below n again."""
        if n < 2:
            return x
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            a, b = x >> half, x & mask
            for i in range(6):
                wide = 0
                for j in range(-(-half // 256)):
                    wide = wide << 256 | self._hash(*tweak, n, i, b, j)
                a, b = b, a ^ (wide & mask)
            x = a << half | b
            if x < n:
                return x

    def _digits(self, digits: str, valid, *tweak: object) -> str:
        """Digits to as many digits; within those for which ``valid`` holds, if it holds for the given."""
        n, x = 10 ** len(digits), int(digits)
        inside = valid(digits)
        while True:
            x = self.permute(x, n, *tweak, len(digits))
            out = f"{x:0{len(digits)}d}"
            if valid(out) == inside:
                return out

    def _text(self, text: str, *tweak: object) -> str:
        """Letters to letters and digits to digits at their places; other characters stay."""
        bases = [26 if c.isalpha() else 10 if c.isdigit() else 1 for c in text]
        x, n = 0, 1
        for c, base in zip(text, bases):
            value = (ord(c) - 97) % 26 if base == 26 else int(c) if base == 10 and c.isdecimal() else 0
            x, n = x * base + value, n * base
        # Letters outside a-z share values with others, so they join the tweak.
        rare = "".join(c for c in text if c.isalnum() and not ("a" <= c <= "z" or "0" <= c <= "9"))
        x, out = self.permute(x, n, *tweak, rare, re.sub("[a-z]", "a", re.sub("[0-9]", "0", text))), []
        for c, base in zip(reversed(text), reversed(bases)):
            x, value = divmod(x, base)
            out.append(chr(97 + value) if base == 26 else str(value) if base == 10 else c)
        return "".join(reversed(out))

    def _of(self, kind: str, value: str, attempt: int = 0) -> str:
        """The surrogate of a normal form, itself a normal form."""
        if kind == "email":
            local, _, domain = value.rpartition("@")
            labels, _, top = domain.rpartition(".")
            return f"{self._text(local, 'local', attempt)}@{self._text(labels, 'domain')}.{top}"
        if kind == "ssn":
            valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
            return self._digits(value, valid, "ssn", attempt)
        if kind == "phone":
            prefix = value[: len(value) - 10] if len(value) > 10 else value[:1] if value[0] == "+" else ""
            rest = value[len(prefix) :]
            valid = lambda d: len(d) < 10 or d[0] in "23456789" and d[3] in "23456789"
            return prefix + self._digits(rest, valid, "phone", prefix, attempt)
        if kind == "card":
            # The first digit tells the brand; the last keeps its distance from the check digit.
            body, last = value[:-1], int(value[-1])
            new = body[0] + self._digits(body[1:], lambda d: True, "card", body[0], attempt)
            return new + str((_check_digit(new) + last - _check_digit(body)) % 10)
        if kind == "ip":
            x = int(ipaddress.IPv4Address(value))
            home = next((i for i, (a, b) in enumerate(_NETWORKS) if a <= x < b), None)
            if home is not None:
                a, b = _NETWORKS[home]
                return str(ipaddress.IPv4Address(a + self.permute(x - a, b - a, "ip", home, attempt)))
            while True:
                x = self.permute(x, 1 << 32, "ip", attempt)
                if not any(a <= x < b for a, b in _NETWORKS):
                    return str(ipaddress.IPv4Address(x))
        if kind == "ipv6":
            # The first 16 bits tell the kind of network and stay.
            x = int(ipaddress.IPv6Address(value))
            return ipaddress.IPv6Address(x >> 112 << 112 | self.permute(x & (1 << 112) - 1, 1 << 112, "ipv6", x >> 112, attempt)).exploded
        if kind == "iban":
            body = self._text(value[4:].lower(), "iban", value[:2], attempt).upper()
            return f"{value[:2]}{98 - _check_97(value[:2] + '00' + body):02d}{body}"
        if kind == "given":
            names = _LISTS[_GENDER[value]]
            # One more place on each attempt; a shift of a keyed order has no fixed point.
            order = sorted(range(len(names)), key=lambda i: self._hash("given", *_GENDER[value], i))
            at = order.index(names.index(value))
            return names[order[(at + 1 + attempt) % len(names)]]
        syllables = SYLLABLES[_script(value)]
        x, word = self._hash("surname", value, attempt), []
        for _ in range(self._syllables + attempt // 2):
            x, i = divmod(x, len(syllables))
            word.append(syllables[i])
        # The ending is that of the family's form, so that a woman's form can be told from it.
        ending = next((m for m, _ in ENDINGS[_script(value)] if value.endswith(m) and len(value) > len(m) + 1), "")
        return "".join(word).capitalize() + ending

    def render(self, kind: str, raw: str, surrogate: str) -> str:
        """A surrogate in the form of the mention: its separators, its upper and lower case, and a surname's gender."""
        if kind in ("given", "surname"):
            gender = family_of(as_written(raw))[1] if kind == "surname" else ""
            if gender == "f":
                man, woman = next(e for e in ENDINGS[_script(surrogate)] if surrogate.endswith(e[0]))
                surrogate = surrogate[: -len(man)] + woman
            return surrogate.upper() if as_written(raw) != raw else surrogate
        if kind == "ipv6":
            short = ipaddress.IPv6Address(surrogate).compressed if "::" in raw else ":".join(f"{int(x, 16):x}" for x in surrogate.split(":"))
            return short.upper() if raw.upper() == raw and any(c.isalpha() for c in raw) else short
        if kind == "iban":
            letters = iter(surrogate)
            return "".join(c if c == " " else next(letters) for c in raw)
        if kind in ("card", "ssn", "phone"):
            digits = iter(surrogate.lstrip("+"))
            return "".join(next(digits) if c.isdigit() else c for c in raw)
        if kind == "email" and len(raw) == len(surrogate):
            return "".join(s.upper() if c.isupper() else s for c, s in zip(raw, surrogate))
        return surrogate


def _range(network: str) -> tuple[int, int]:
    n = ipaddress.IPv4Network(network)
    return int(n.network_address), int(n.broadcast_address) + 1


#: Networks whose addresses stay in them.
_NETWORKS = [_range(n) for n in ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/3")]


def _check_digit(body: str) -> int:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = {m[:2] for text in batch.column("text") for m in mentions(text.as_py())}
        columns = [*zip(*found)] or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["kind", "value"])


def changed_attempts(entities: DataFrame, key: str, syllables: int = NAME_SYLLABLES) -> DataFrame:
    """The entities whose first surrogate won't do, with the attempt that does: (kind, value, attempt).

    A surrogate won't do if it is the entity itself, or is an entity of its kind
    anywhere in the documents, or if an entity less than this has the same one
    (given names, of which there is a list, may stand for each other and only
    must differ).  Entities and surrogates meet in joins by kind and value.
    """
    given_differs = "kind = 'given'"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key, syllables)
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "value", "attempt")))
            made = [surrogates.of(k, v, a) for k, v, a in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, "made"])

    schema = "kind string, value string, attempt int, made string"
    current = materialize(entities.selectExpr("kind", "value", "0 AS attempt").mapInArrow(make, schema), "surrogates")
    for _ in range(MAX_ATTEMPTS):
        holders = current.groupBy("kind", "made").agg(F.min("value").alias("holder"), F.count(F.lit(1)).alias("n"))
        taken = entities.select("kind", F.col("value").alias("made"), F.lit(True).alias("real"))
        judged = current.join(holders.join(taken, ["kind", "made"], "left"), ["kind", "made"])
        bad = F.when(F.expr(given_differs), F.col("made") == F.col("value")).otherwise(
            F.coalesce("real", F.lit(False)) | ((F.col("n") > 1) & (F.col("value") != F.col("holder")))
        )
        judged = materialize(judged.select("kind", "value", "attempt", "made", bad.alias("bad")), "judged")
        if not judged.where("bad").limit(1).count():
            return judged.where("attempt > 0").select("kind", "value", "attempt")
        again = judged.where("bad").selectExpr("kind", "value", "attempt + 1 AS attempt").mapInArrow(make, schema)
        current = materialize(judged.where("NOT bad").select("kind", "value", "attempt", "made").union(again), "surrogates")
    raise RuntimeError(f"surrogates collide after {MAX_ATTEMPTS} attempts")


#: What ``replace_pii`` adds.
ADDED = ("n_entities", "kinds")


def replace_pii(docs: DataFrame, key: str, syllables: int = NAME_SYLLABLES) -> DataFrame:
    """Replaces personal data in ``text``; adds ``n_entities`` (mentions) and ``kinds`` (sorted, comma-joined).

    All mentions of an entity, in any row, get one surrogate, and different
    entities get different ones.  A surname alone counts as a mention in a text
    that also has it after a given name or a title.  Rows
    without mentions keep their text to the letter; null stays null.  Repeated
    rows change alike.  Other columns pass through; ones by the added names are
    replaced.
    """
    if not key:
        raise ValueError("surrogates need a key")
    spark = docs.sparkSession
    entities = docs.select("text").mapInArrow(_entities, "kind string, value string").distinct()
    changed = changed_attempts(materialize(entities, "entities"), key, syllables)
    own = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    rows = docs.select(own)
    few = changed.count() <= BROADCAST_ROWS
    attempts = {(r.kind, r.value): r.attempt for r in changed.toLocalIterator()} if few else {}
    if not few:
        rows = _with_attempts(rows, changed)
    known = spark.sparkContext.broadcast(attempts)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key, syllables)
        for batch in batches:
            texts, counts, kinds = [], [], []
            told = [None] * batch.num_rows if few else batch.column("_attempts").to_pylist()
            for text, mine in zip(batch.column("text").to_pylist(), told):
                found = mentions(text)
                if found:
                    attempt = known.value if few else {(x["kind"], x["value"]): x["attempt"] for x in mine or ()}
                    parts, at = [], 0
                    for kind, value, start, end in found:
                        new = surrogates.of(kind, value, attempt.get((kind, value), 0))
                        parts += [text[at:start], surrogates.render(kind, text[start:end], new)]
                        at = end
                    text = "".join([*parts, text[at:]])
                texts.append(text)
                counts.append(len(found))
                kinds.append(",".join(sorted({m[0] for m in found})))
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in own]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], [*own, "n_entities", "kinds"]
            )
        give_back()

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(own).schema)
    return rows.mapInArrow(replace, ddl + ", n_entities long, kinds string")


def _with_attempts(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows with what is changed of their own entities, when it is too much to tell all tasks."""
    # The number is written with the row: made anew at each reading, it could differ.
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(r, *m) for r, t in zip(batch.column("_row").to_pylist(), batch.column("text")) for m in {x[:2] for x in mentions(t.as_py())}]
            columns = [*zip(*found)] or [()] * 3
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["_row", "kind", "value"])

    own = rows.select("_row", "text").mapInArrow(listed, "_row long, kind string, value string").join(changed, ["kind", "value"])
    own = own.groupBy("_row").agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("_attempts"))
    return rows.join(own, "_row", "left").drop("_row")


def session_key(spark: SparkSession) -> str:
    """The key set for the session; where none is, a random one that the session keeps.

    Without a key of one's own, surrogates are the same within a session and other
    in the next.
    """
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return replace_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
