"""Personal data: surrogates for detected entities.

Detected are e-mail addresses, phone numbers, card numbers (Luhn), IPv4 addresses, social security numbers, IBANs, access keys,
secrets after ``password=``, ``token =`` and the like, and names after a title.  Each distinct entity gets a replacement that a secret key, which the caller gives, determines:

- digits, hexadecimal digits and letters are permuted within their class, length, case and script by a keyed Feistel cipher over the
  characters to replace, so distinct entities of a type and format have distinct surrogates and the same entity has the same one everywhere;
- cards keep their first digit, length, grouping and a valid Luhn digit; IPs stay IPs; mail domains and phone and country prefixes keep their form;
- names are taken from lists of the title's gender and the name's script, and carry a keyed suffix where two names would coincide.

Entities are known by a normal form: mail addresses without case, phones, cards and IBANs without separators.  A name takes all its capitalised words;
within a document, later and earlier mentions of it without a title, and of its single words, get the same surrogate or its matching word.

Collisions are checked over the whole corpus: distinct entities are gathered once by key, surrogates that two entities share, or that
are themselves an entity of the corpus, are drawn again with the next number until none is left.  A cipher can only meet an entity of the corpus,
and a name another name: these few go in a table, joined by key with the documents that hold them.

Null text stays null, with no entities.  Rows: one for each input row, all columns kept; repeated rows get equal surrogates.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import re
import secrets
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROUNDS, KEY_NAME, LEAST_KEY = 8, "NOTEWRIGHT_PII_KEY", 16
#: Titles by gender, and given names by script and gender (fixed values).
TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "Г-н", "Κύριος"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа", "Κυρία"), "n": ("Dr", "Prof", "Mx")}
GIVEN = {
    ("LATIN", "m"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leon", "Martin", "Oscar", "Paul", "Simon", "Victor", "Walter"),
    ("LATIN", "f"): ("Alice", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helen", "Irene", "Julia", "Laura", "Maria", "Nora", "Olivia", "Sara", "Vera"),
    ("LATIN", "n"): ("Alex", "Andrea", "Billie", "Charlie", "Dominique", "Jamie", "Kim", "Robin"),
    ("CYRILLIC", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Олег", "Павел"),
    ("CYRILLIC", "f"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"),
    ("CYRILLIC", "n"): ("Женя", "Саша", "Валя", "Слава"),
    ("GREEK", "m"): ("Άρης", "Γιώργος", "Κώστας", "Νίκος", "Πέτρος"),
    ("GREEK", "f"): ("Άννα", "Ελένη", "Ζωή", "Μαρία", "Σοφία"),
    ("GREEK", "n"): ("Αλέξ", "Φώτης"),
}
SYLLABLES = {"LATIN": "ba be bo da de do ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo", "CYRILLIC": "ба бе бо да де до ка ке ко ла ле ло ма ме мо на не но ра ре ро", "GREEK": "βα βε βο δα δε δο κα κε κο λα λε λο μα με μο να νε νο ρα ρε ρο"}
#: Lower-case words within names, and capitalised words that no name goes on with (fixed values).
PARTICLES = ("de", "del", "della", "la", "las", "los", "di", "da", "do", "dos", "du", "le", "van", "von", "der", "den", "ter", "zu", "bin", "ibn", "al", "el", "y", "e")
NO_NAME = set("A After Also An And As At Before But By For From Has He Her His How I If In Is It My No Not Of On Or Our She So That The Their Then There They This To Was We What When Where Who Why With Yes You Your".split())
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
#: A type's pattern; what is replaced is group v where there is one.
PATTERNS = (
    ("email", r"(?<![\w.+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?!\w)"),
    ("key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("secret", r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b\s*[=:]\s*[\"']?)(?P<v>[A-Za-z0-9_\-/+]{6,})"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
    ("card", r"(?<![\w-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])"),
    ("phone", r"(?<![\w+])(?:(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}(?:[ .-]\d{2,4}){2,5}|\+\d{9,14}|\d{3}(?P<sep>[ .-])\d{3}(?P=sep)\d{4})(?![\w-]|\.\d)"),
    ("name", r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(_GENDER, key=len, reverse=True))) + r")\.? (?P<v>[^\W\d_]+(?:['’-][^\W\d_]+)*)"),
)
#: What may follow in a name: an initial's dot, particles, a further word.
_FURTHER = re.compile(r"(?:(?<=\b[^\W\d_])\.)? (?:(?:" + "|".join(PARTICLES) + r") )*(?P<w>[^\W\d_]+(?:['’-][^\W\d_]+)*)")
_ALL = re.compile("|".join(f"(?P<{n}>{p.replace('?P<v>', f'?P<v_{n}>')})" for n, p in PATTERNS))
#: A text with none of these has none of the entities.
_HINT = re.compile(r"[0-9@]|A[KS]IA[A-Z]{16}|[=:]\s*[\"']?[A-Za-z0-9_\-/+]{6}|(?:" + "|".join(map(re.escape, _GENDER)) + r")\.? ")


_drawn: list[bytes] = []


def secret_key() -> bytes:
    """The key in the environment variable NOTEWRIGHT_PII_KEY; where it is unset, one drawn at random for this process and kept nowhere.

    There is no key in the source: who doesn't hold it can't invert the ciphers.  Surrogates that must agree between runs need the variable.
    """
    given = os.environ.get(KEY_NAME, "").encode()
    if given:
        return checked_key(given)
    if not _drawn:
        _drawn.append(secrets.token_bytes(32))
    return _drawn[0]


def checked_key(key: bytes) -> bytes:
    if len(key) < LEAST_KEY:
        raise ValueError(f"a surrogate key has {LEAST_KEY} bytes at least")
    return key


def luhn_digit(digits: str) -> str:
    total = sum(int(d) if i % 2 else (int(d) * 2 - 9 if int(d) > 4 else int(d) * 2) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def accept(kind: str, value: str) -> bool:
    digits = [c for c in value if c.isdigit()]
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn_digit("".join(digits[:-1])) == digits[-1] or len(digits) == 16 and value.isdigit()
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "name":
        return value[0].isupper()
    if kind == "secret":
        return any(c.isdigit() for c in value)
    return True


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, context) of each entity; the context is a name's title."""
    if not _HINT.search(text):
        return []
    out, at = [], 0
    while m := _ALL.search(text, at):
        kind = next(n for n, _ in PATTERNS if m[n] is not None)
        group = f"v_{kind}" if f"v_{kind}" in _ALL.groupindex else kind
        start, end = m.span(group)
        context = ""
        if kind == "name":
            while (w := _FURTHER.match(text, end)) and w["w"][0].isupper() and w["w"] not in NO_NAME and w["w"] not in _GENDER:
                end = w.end()
            context = text[m.start() : start].rstrip(". ")
        if accept(kind, text[start:end]):
            out.append((start, end, kind, context))
            at = end
        else:
            at = m.end() if kind in ("card", "phone", "iban") else max(start + 1, m.start() + 1)
    return out


def name_words(name: str) -> list[str]:
    """The words of a name that get words of its surrogate: all but particles; capitals and dots don't matter."""
    words = [w.rstrip(".") for w in name.split()]
    return [w.capitalize() if len(w) > 2 and w.isupper() else w for w in words if w not in PARTICLES]


def normal(kind: str, value: str) -> str:
    """What an entity is known by, however it is written."""
    if kind == "email":
        return value.lower()
    if kind in ("phone", "card"):
        return "".join(c for c in value if c.isdigit() or c == "+")
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ip":
        return ".".join(str(int(x)) for x in value.split("."))
    return " ".join(name_words(value)) if kind == "name" else value


def fitted(kind: str, value: str, new: str, part: tuple[int, ...] = ()) -> str:
    """The surrogate of a normal form in the way that the entity, or the parts of a name, are written."""
    if kind == "email":
        return "".join(b.upper() if a.isupper() else b for a, b in zip(value, new, strict=True))
    if kind in ("phone", "card", "iban"):
        left = iter(c for c in new if c != "+")
        return "".join(next(left) if c.isalnum() else c for c in value)
    if kind == "name":
        if part:
            words = new.split()
            new = " ".join(words[i] for i in part)
        return new.upper() if len(value) > 2 and value.isupper() else new
    return new


def mentions(text: str) -> list[tuple[int, int, str, str, str, tuple[int, ...]]]:
    """(start, end, type, context, normal form, parts) of each entity, and of each further mention of a name or a part of it.

    A name whose words a longer name of the text has is a mention of that one; parts number the words of its surrogate, and
    none are the whole.  Of names that share a word, the longest and then the first has the word alone.
    """
    found = [(a, b, kind, context, normal(kind, text[a:b])) for a, b, kind, context in find(text)]
    titled = dict.fromkeys(f[4] for f in reversed(found) if f[2] == "name")
    if not titled:
        return [(*f, ()) for f in found]
    contexts = {f[4]: f[3] for f in reversed(found) if f[2] == "name"}
    whole: dict[str, tuple] = {}
    alone: dict[str, tuple] = {}
    for name in sorted(reversed(titled), key=lambda n: -len(n.split())):
        words = name.split()
        longer = next((n for n, (_, part) in whole.items() if not part and len(n.split()) > len(words) and set(words) <= set(n.split())), None)
        if longer:
            whole[name] = (longer, tuple(longer.split().index(w) for w in words))
            continue
        whole[name] = (name, ())
        for i, w in enumerate(words):
            for x in {w, *w.split("-")}:
                if len(x) > 1 and x[0].isupper() and x not in NO_NAME:
                    alone.setdefault(x, (name, (i,) if len(words) > 1 else ()))
    out = [(a, b, kind, contexts[whole[v][0]], *whole[v]) if kind == "name" else (a, b, kind, context, v, ()) for a, b, kind, context, v in found]
    forms = {**alone, **whole, **{text[a:b]: whole[v] for a, b, kind, _, v in found if kind == "name"}}
    forms |= {f.upper(): x for f, x in list(forms.items()) if len(f) > 2 and f.upper() not in forms}
    again = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(f) for f in sorted(forms, key=len, reverse=True) if len(f) > 1) + r")(?!\w)")
    spans, k, more = sorted(x[:2] for x in out), 0, []
    for m in again.finditer(text):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        if k == len(spans) or spans[k][0] >= m.end():
            name, part = forms[m[0]]
            more.append((*m.span(), "name", contexts[name], name, part))
    return sorted(out + more)


#: Lengths of country codes: one digit for 1 and 7, two for these, else three (ITU-T E.164).
_TWO_DIGITS = {"20", "27", *map(str, range(30, 35)), "36", "39", "40", "41", *map(str, range(43, 50)), *map(str, range(51, 59)), *map(str, range(60, 67)), "81", "82", "84", "86", *map(str, range(90, 96)), "98"}


def country_digits(phone: str) -> int:
    """Digits of the country code of a phone number in normal form."""
    return 0 if phone[0] != "+" else 1 if phone[1] in "17" else 2 if phone[1:3] in _TWO_DIGITS else 3


def _prf(key: bytes, *parts) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")


_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def permute(value: str, key: bytes, tweak: str, keep=lambda i, c: False, hexadecimal: bool = False) -> str:
    """A bijection among strings of the same format: an alternating Feistel network over mixed radices."""
    sets = []
    for i, c in enumerate(value):
        if keep(i, c):
            continue
        own = next((s for s in (_DIGIT, _LOWER, _UPPER) if c in s), None)
        if hexadecimal and c in "0123456789abcdef":
            own = "0123456789abcdef"
        if own:
            sets.append((i, own))
    if not sets:
        return value
    shape = "".join(c if keep(i, c) else "9" if c in _DIGIT else "a" if c in _LOWER else "A" if c in _UPPER else c for i, c in enumerate(value))
    if hexadecimal:
        shape = f"hex{len(value)}"
    digits = [s.index(value[i]) for i, s in sets]
    half = len(sets) // 2 or 1
    sides = (range(0, half), range(half, len(sets)))
    for r in range(ROUNDS):
        own, other = sides[r % 2], sides[1 - r % 2]
        mask = _prf(key, tweak, shape, r, *(digits[j] for j in other))
        for j in own:
            n = len(sets[j][1])
            mask, add = divmod(mask, n) if mask >= n else (_prf(key, tweak, shape, r, j, *(digits[k] for k in other)), mask)
            digits[j] = (digits[j] + add) % n
    out = list(value)
    for (i, s), d in zip(sets, digits, strict=True):
        out[i] = s[d]
    return "".join(out)


def script_of(word: str) -> str:
    name = unicodedata.name(next((c for c in word if c.isalpha()), "a"), "LATIN").split()[0]
    return name if name in SYLLABLES else "LATIN"


def surrogate(kind: str, value: str, context: str, key: bytes, draw: int = 0) -> str:
    """The draw-th replacement of an entity; ciphers differ by draw too."""
    tweak = f"{kind}{draw or ''}"
    if kind == "email":
        local, _, domain = value.partition("@")
        last = domain.rindex(".")
        host = permute(domain[:last], key, tweak + "@")
        return f"{permute(local, key, tweak)}@{host}{domain[last:]}"
    if kind == "card":
        digits = [c for c in value if c.isdigit()]
        valid = luhn_digit("".join(digits[:-1])) == digits[-1]
        body = permute("".join(digits[:-1]), key, tweak, keep=lambda i, c: i == 0)
        new = body + (luhn_digit(body) if valid else str((int(luhn_digit(body)) + int(digits[-1]) - int(luhn_digit("".join(digits[:-1])))) % 10))
        left = iter(new)
        return "".join(next(left) if c.isdigit() else c for c in value)
    if kind == "ip":
        a = [int(x) for x in value.split(".")]
        halves = [a[0] << 8 | a[1], a[2] << 8 | a[3]]
        for r in range(ROUNDS):
            halves[r % 2] = (halves[r % 2] + _prf(key, tweak, r, halves[1 - r % 2])) % 65536
        return ".".join(str(b) for h in halves for b in (h >> 8, h & 255))
    if kind == "phone":
        first = country_digits(value)
        return permute(value, key, tweak, keep=lambda i, c: i <= first and value[0] == "+")
    if kind == "key":
        return permute(value, key, tweak, keep=lambda i, c: i < 4)
    if kind == "iban":
        return permute(value, key, tweak, keep=lambda i, c: i < 2)
    if kind == "secret":
        return permute(value, key, tweak, hexadecimal=bool(re.fullmatch(r"[0-9a-f]+", value)))
    if kind == "name":
        script, gender = script_of(value), _GENDER.get(context, "n")
        n = _prf(key, tweak, value)
        given = GIVEN[script, gender]
        parts = [given[n % len(given)]]
        syllables = SYLLABLES[script].split()
        n //= len(given)
        for more in range(max(len(value.split()) - 1, int("-" in value or draw > 0))):
            if more:
                n = _prf(key, tweak, value, more)
            parts.append("".join(syllables[n // len(syllables) ** i % len(syllables)] for i in range(3 + draw // 8)).capitalize())
        return " ".join(parts)
    return permute(value, key, tweak)


def _entities(key: bytes):
    def run(batches):
        for batch in batches:
            found: dict = {}
            for text in batch.column(0).to_pylist():
                if text:
                    for _, _, kind, context, value, _ in mentions(text):
                        found[kind, value, _GENDER.get(context, "") and context] = None
            rows = [(k, v, c, surrogate(k, v, c, key)) for k, v, c in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["kind", "value", "context", "surrogate"])

    return run


def _redraw(key: bytes, draw: int):
    def run(batches):
        for batch in batches:
            kind, value, context = (c.to_pylist() for c in batch.columns[:3])
            new = [surrogate(k, v, c, key, draw) for k, v, c in zip(kind, value, context, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(new, pa.string())], ["kind", "value", "context", "surrogate"])

    return run


def surrogate_table(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """(kind, value, surrogate, changed) of all distinct entities; surrogates are distinct within a kind and no entity of it."""
    shape = "kind string, value string, context string, surrogate string"
    found = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text")).mapInArrow(_entities(key), shape)
    # a name with two titles is one entity: the titles' least decides its gender
    table = found.groupBy("kind", "value").agg(F.min(F.struct("context", "surrogate")).alias("x")).select("kind", "value", "x.context", "x.surrogate", F.lit(0).alias("draw"))
    table = common.materialise(table, "pii-surrogates")
    draw = 0
    while True:
        shared = table.groupBy("kind", "surrogate").agg(F.min("value").alias("owner"), F.count("*").alias("n"))
        clash = table.join(shared.where("n > 1"), ["kind", "surrogate"]).where("value <> owner").select("kind", "value")
        own = table.join(table.select("kind", F.col("value").alias("surrogate")), ["kind", "surrogate"], "left_semi").select("kind", "value")
        again = common.materialise(clash.unionAll(own).distinct(), "pii-collisions")
        if again.isEmpty():
            return table.select("kind", "value", "surrogate", (F.col("draw") > 0).alias("changed"))
        draw += 1
        if draw > 64:
            raise ValueError("no distinct surrogates found in 64 draws")
        moved = table.join(again, ["kind", "value"], "left_semi").select("kind", "value", "context").mapInArrow(_redraw(key, draw), shape).withColumn("draw", F.lit(draw))
        table = common.materialise(table.join(again, ["kind", "value"], "left_anti").unionAll(moved.select(table.columns)), "pii-surrogates")


def replace(text: str, key: bytes, table: dict) -> tuple[str, int, list[str]]:
    out, at, kinds = [], 0, []
    for a, b, kind, context, value, part in mentions(text):
        new = table.get((kind, value)) or surrogate(kind, value, context, key)
        out += [text[at:a], fitted(kind, text[a:b], new, part)]
        kinds.append(kind)
        at = b
    return "".join([*out, text[at:]]), len(kinds), sorted(set(kinds))


def _replacing(key: bytes, text_at: int, n_columns: int, names):
    def run(batches):
        for batch in batches:
            texts, counts, kinds = [], [], []
            for text, pairs in zip(batch.column(text_at).to_pylist(), batch.column(n_columns).to_pylist(), strict=True):
                table = {(p["kind"], p["value"]): p["surrogate"] for p in pairs or ()}
                new, n, ks = (None, 0, []) if text is None else replace(text, key, table)
                texts.append(new)
                counts.append(n)
                kinds.append(",".join(ks))
            columns = list(batch.columns[:n_columns])
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32()), pa.array(kinds, pa.string())], names)

    return run


def _holders(batches):
    for batch in batches:
        for uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = sorted({(m[2], m[4]) for m in mentions(text)}) if text else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([uid] * len(rows), pa.int64()), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["uid", "kind", "value"])


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """The rows with their texts' entities replaced, and n_entities and entity_types (names are free of clashes)."""
    spark = docs.sparkSession
    common.prepare(spark)
    checked_key(key)
    changed = common.materialise(surrogate_table(docs, key, text_col).where("changed or kind = 'name'").select("kind", "value", "surrogate"), "pii-changed")
    n_entities, types = common.free_name(docs, "n_entities"), common.free_name(docs, "entity_types")
    pairs = common.free_name(docs, "pairs")
    if changed.isEmpty():
        rows = docs.withColumn(pairs, F.lit(None).cast("array<struct<kind:string,value:string,surrogate:string>>"))
    else:
        uid = common.free_name(docs, "uid")
        # stored, so that a row has one number wherever it is read
        numbered = common.materialise(docs.withColumn(uid, F.monotonically_increasing_id()), "pii-numbered")
        held = numbered.select(F.col(uid).alias("uid"), F.col(text_col).cast("string").alias("text")).mapInArrow(_holders, "uid long, kind string, value string")
        # a document's list is bounded by the entities it holds
        lists = held.join(changed, ["kind", "value"]).groupBy("uid").agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias(pairs))
        rows = numbered.join(lists.withColumnRenamed("uid", uid), uid, "left").drop(uid)
    names = [*docs.columns, n_entities, types]
    schema = docs.withColumn(text_col, F.col(text_col).cast("string")).withColumn(n_entities, F.lit(0)).withColumn(types, F.lit("")).schema
    rows = rows.withColumn(text_col, F.col(text_col).cast("string"))
    return rows.mapInArrow(_replacing(key, docs.columns.index(text_col), len(docs.columns), names), schema)
