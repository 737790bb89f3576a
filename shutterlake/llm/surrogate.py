"""PII: keyed surrogates for detected entities.

Mentions of emails, addresses (IPv4 and IPv6), phone, card, account (IBAN too) and social
numbers and of titled persons are found by patterns; a person's names are found again anywhere
in the same text, with a title or without, by one pass over its words. Names that are plain
words as well (COMMON, or in lower case elsewhere in the text) are replaced behind a title
only. Names may hold initials, particles, apostrophes and hyphens, and be in capitals like
their title. In scripts without capitals a title is followed by two words at most, or by a Han
name of up to three characters, four with a double surname. Each distinct entity gets one surrogate derived from a secret key: digits for
digits and letters for letters of the same script and case, valid checksums for valid ones,
given names of the title's gender. A phone number's first digit and an email's last domain
stay. Equal entities get equal surrogates in every document whatever their separators or
case (coreference). Surrogates of all entities are compared: one that two entities share, or
that is a real entity's own, is drawn again, so that different entities stay different;
after GROW draws of a short form, 4 * GROW of others, a surrogate grows by a character, so
that no form is ever used up (a form that is half used up fails 32 draws once in 2**32
times; addresses never grow).

Edge cases: a null or empty text stays as it is and has no mentions; an empty key is
refused; rows of equal ids and texts give equal results; an empty table gives an empty
result; further columns are carried over, and columns of an output's name replaced.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import ipaddress
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.llm.store import kept, spare
from shutterlake.llm.text_arrays import map_slices

#: Starts at the head of a run only, so a long run is read once.
EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]++@[\w-]++(?:\.[\w-]+)+")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)")
IBAN_HINT = re.compile("[A-Z]{2}[0-9]{2}")
IPV6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{4,39}(?![\w:])")
INTERNATIONAL = re.compile(r"(?<![\w+])\+[1-9](?:[ .()-]{0,2}[0-9]){7,14}(?!\w)")
NUMBERS = re.compile(
    r"(?P<ip>(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9]))"
    r"|(?P<social>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<phone>(?:\+[0-9]{1,3}[ .-]?|(?<![\w.+-]))(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?!\w))"
    r"|(?P<card>(?<![\w.])[0-9](?:[ -]?[0-9]){12,18}(?!\w))"
)
TITLES = {"Mr": "m", "Mister": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Господин": "m", "السيد": "m"}
TITLES |= {"Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "Госпожа": "f", "السيدة": "f"}
TITLES |= {"Dr": "n", "Prof": "n", "Доктор": "n", "الدكتور": "n"}
#: Titles that count in lower case too; others are words then.
LOWER_TITLES = {"mr": "m", "mrs": "f"}
#: Titles that follow the name.
AFTER = {"先生": "m", "女士": "f", "小姐": "f"}
# Particles of names, Han surnames of two characters, and names that are words.
PARTICLES = "de|del|della|di|da|do|dos|das|du|des|la|le|las|los|van|von|vom|zu|zum|zur|der|den|ten|ter|af|av|bin|ibn|ben|al|el|y|e|san|st"
DOUBLE = "欧阳|司马|上官|诸葛|夏侯|东方|皇甫|尉迟|公孙|慕容|令狐|宇文|长孙|司徒|南宫|端木|独孤|百里"
COMMON = set(
    "will young may mark rose hope grace bill rich long king green brown white black gray grey hill wood field stone rivers banks page price church cook baker carter mason hunter fisher porter "
    "day may june april august summer winter frost snow rain love joy faith art bob chase dean drew earl frank gene guy jack john lance miles nick pat pierce ray rob rod sandy sue victor wade ward "
    "klein gross lang kurz schwarz weiss koch bauer mann stein wolf petit grand blanc noir roi jour reyes flores rojo cruz"
    .split()
)
_HAN = f"(?:(?:{DOUBLE})[\u3400-\u9fff]{{1,2}}|[\u3400-\u9fff]{{1,3}})"
_WORD = r"[^\W\d_\u3400-\u9fff]++(?:['’-][^\W\d_\u3400-\u9fff]++)*+"
#: A name's further parts: words, initials with their full stop, and particles before a word.
_NEXT = rf"(?:\x20(?:(?:{PARTICLES})\x20){{0,3}}(?:\w\.|{_WORD}))"
_TITLE = "|".join(sorted([*TITLES, *(t.upper() for t in TITLES), *LOWER_TITLES], key=len, reverse=True))
PERSON = re.compile(rf"\b({_TITLE})\b\.?\x20({_HAN}|(?:(?:{PARTICLES})\x20){{0,3}}(?:\w\.|{_WORD}){_NEXT}{{0,5}})")
NAMED = re.compile(rf"((?:{DOUBLE})[\u3400-\u9fff]{{1,2}}|[\u3400-\u9fff]{{2,3}}?)({'|'.join(AFTER)})")
WORDS = re.compile(_WORD)
HAN_RUN = re.compile("[\u3400-\u9fff]{2,}")
KIND_OF_TITLE = TITLES | {t.upper(): k for t, k in TITLES.items()} | LOWER_TITLES
TITLE_HINT = re.compile("[Mm][Rrs]|M[IS]|DR|PROF|HERR|FRAU|SE|SR|ГОСП|ДОКТ|MON|MAD|MME|Mis|Herr|Frau|Mon|Mad|Mme|Se|Sr|Dr|Prof|Госп|Докт|الس|الد|先生|女士|小姐")

#: (consonants, vowels, endings of female given names) of scripts whose words can be read out.
ALPHABETS = {
    "LATIN": ("bcdfghjklmnprstvwz", "aeiou", "a"),
    "CYRILLIC": ("бвгджзклмнпрстфхц", "аеиоу", "а"),
    "GREEK": ("βγδζθκλμνπρστφχ", "αειου", "α"),
    "ARABIC": ("بتجدرسفكلمنه", "اوي", "ة"),
    "HEBREW": ("בגדהזחטכלמנספצקרשת", "אוי", "ה"),
    "CJK": ("伟强磊军勇杰涛明超刚平林海山川文", "伟强磊军勇杰涛明超刚平林海山川文", "芳"),
}
#: Draws of a surrogate before it grows.
GROW = 8
MENTION = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("entity", T.StringType())])
)
#: Mentions up to which the documents' lists may be broadcast (about 100 bytes each).
BROADCAST_MENTIONS = 300_000


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mentions(text: str) -> list[dict]:
    """kind, start, end (code points) and canonical entity of a text's mentions, in order."""
    out = []
    if "@" in text:
        out += [("email", *m.span(), m.group().lower()) for m in EMAIL.finditer(text)]
    for m in NUMBERS.finditer(text):
        kind, digits = m.lastgroup, re.sub("[^0-9]", "", m.group())
        if kind == "ip":
            if any(int(x) > 255 for x in m.group().split(".")):
                continue
            digits = ".".join(str(int(x)) for x in m.group().split("."))
        elif kind == "card" and not luhn(digits):
            kind = "account"
        out.append((kind, *m.span(), digits))
    if "+" in text:
        out += [("phone", *m.span(), re.sub("[^0-9]", "", m.group())) for m in INTERNATIONAL.finditer(text)]
    if text.count(":") > 1:
        out += [("ipv6", *m.span(), own) for m in IPV6.finditer(text) if (own := ipv6(m.group()))]
    if IBAN_HINT.search(text):
        for m in IBAN.finditer(text):
            whole = m.group()
            while whole and not iban(whole):  # words in capitals may follow
                whole = whole.rpartition(" ")[0]
            if whole:
                out.append(("iban", m.start(), m.start() + len(whole), whole.replace(" ", "")))
    if TITLE_HINT.search(text):
        out += persons(text)
    out.sort(key=lambda x: (x[1], -x[2]))
    clear, end = [], 0
    for kind, a, b, entity in out:
        if a >= end:
            clear.append({"kind": kind, "start": a, "end": b, "entity": entity})
            end = b
    return clear


def ipv6(text: str) -> str | None:
    """The address in its short form; None if it is none, or has fewer than two numbers."""
    try:
        own = str(ipaddress.IPv6Address(text if text.endswith("::") else text.rstrip(":")))
    except ValueError:
        return None
    return own if len(re.findall("[0-9a-f]+", own)) > 1 else None


def iban(text: str) -> bool:
    """Whether the check digits of an account number are right."""
    own = text.replace(" ", "")
    return 15 <= len(own) <= 34 and int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1


def persons(text: str) -> list[tuple]:
    """Names of titled persons, and where the same names stand alone."""
    out, names = [], {}

    def put(a: int, b: int, kind: str) -> None:
        out.append((kind, a, b, text[a:b].casefold()))
        names.setdefault(text[a:b], kind)

    for m in PERSON.finditer(text):
        parts, at = [], m.start(2)
        for word in m.group(2).split(" "):
            small = re.fullmatch(PARTICLES, word)
            cased = word[0].islower() or word[0].isupper()
            # Words are names if they begin with a capital (the first one behind a title in
            # lower case in any case); scripts without capitals give two.
            name = word[0].isupper() or (not parts and (not cased or m.group(1) in LOWER_TITLES)) or (not cased and len(parts) < 2)
            if name and not (small and parts and not word[0].isupper()):
                parts.append((at, at + len(word.rstrip("."))))
            elif not small:
                break
            at += len(word) + 1
        for k, (a, b) in enumerate(parts, 1):
            put(a, b, "surname" if k == len(parts) else f"given_{KIND_OF_TITLE[m.group(1)]}")
    for m in NAMED.finditer(text):
        put(*m.span(1), f"given_{AFTER[m.group(2)]}")
    if not names:
        return out
    # Single letters and plain words are names behind their title only.
    seen = {w for m in WORDS.finditer(text) if (w := m.group())[0].islower()}
    alone = {n for n in names if len(n) > 2 and script(n) != "CJK" and n.casefold() not in COMMON and n.casefold() not in seen}
    for m in WORDS.finditer(text):
        whole, at = m.group(), m.start()
        if whole in alone:
            out.append((names[whole], *m.span(), whole.casefold()))
            continue
        for part in re.split("['’-]", whole):
            if part in alone:
                out.append((names[part], at, at + len(part), part.casefold()))
            at += len(part) + 1
    han = {n for n in names if script(n) == "CJK" and len(n) > 1}
    for run in HAN_RUN.finditer(text) if han else ():
        own = run.group()
        for i in range(len(own)):
            for size in (4, 3, 2):
                if own[i : i + size] in han and i + size <= len(own):
                    out.append((names[own[i : i + size]], run.start() + i, run.start() + i + size, own[i : i + size]))
                    break
    return out


class Stream:
    """Keyed numbers of one entity."""

    def __init__(self, key: bytes, *parts: object):
        self.key, self.parts, self.n, self.held = key, "\x1f".join(map(str, parts)).encode(), 0, b""

    def below(self, limit: int) -> int:
        if len(self.held) < 4:
            self.held += hmac.new(self.key, self.parts + b"\x1f%d" % self.n, hashlib.sha256).digest()
            self.n += 1
        value, self.held = int.from_bytes(self.held[:4], "big"), self.held[4:]
        return value % limit

    def of(self, items: str) -> str:
        return items[self.below(len(items))]


def script(word: str) -> str:
    """The script of the first letter."""
    return next((unicodedata.name(c, "LATIN").split(" ")[0] for c in word if c.isalpha()), "LATIN")


@functools.cache
def letters(of: str) -> tuple[str, str, str]:
    """Consonants, vowels and female endings; for scripts without a table their letters."""
    if of in ALPHABETS:
        return ALPHABETS[of]
    found = "".join(c for c in map(chr, range(0x100, 0xD7A4)) if unicodedata.category(c) in ("Lo", "Ll") and unicodedata.name(c, "").startswith(of + " "))[:2000]
    return (found, found, found) if found else ALPHABETS["LATIN"]


def _alike(text: str, stream: Stream) -> str:
    """Digits for digits, and pronounceable letters of the same script for letters."""
    out, vowel = [], False
    consonants, vowels, _ = letters(script(text))
    for c in text:
        if c.isdigit():
            out.append(stream.of("0123456789"))
        elif c.isalpha():
            out.append(stream.of(vowels if vowel else consonants))
            vowel = not vowel
        else:
            out.append(c)
            vowel = False
    return "".join(out)


def surrogate(kind: str, entity: str, attempt: int, key: bytes) -> str:
    """One canonical surrogate; later attempts draw anew, and grow where the form allows it."""
    stream = Stream(key, kind, entity, attempt)
    more = attempt // (GROW if len(entity) < 6 else 4 * GROW)
    if kind == "email":
        local, _, domain = entity.partition("@")
        head, _, last = domain.rpartition(".")
        return f"{_alike(local, stream)}{''.join(stream.of('0123456789') for _ in range(more))}@{_alike(head, stream)}.{last}"
    if kind == "ip":
        return ".".join(str(1 + stream.below(254)) for _ in range(4))
    if kind == "ipv6":
        return re.sub("[0-9a-f]+", lambda m: stream.of("123456789abcdef") + "".join(stream.of("0123456789abcdef") for _ in m.group()[1:]), entity)
    if kind == "iban":
        own = "".join(stream.of("0123456789") if c.isdigit() else stream.of("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for c in entity[4:])
        check = 98 - int("".join(str(int(c, 36)) for c in own + entity[:2] + "00")) % 97
        return f"{entity[:2]}{check:02d}{own}"
    if kind in ("phone", "social", "card", "account"):
        first = entity[0] if kind == "phone" or entity[0] == "0" else stream.of("123456789")
        digits = first + "".join(stream.of("0123456789") for _ in range(len(entity) - 1 + more))
        if kind in ("card", "account"):
            valid = next(d for d in "0123456789" if luhn(digits[:-1] + d))
            digits = digits[:-1] + (valid if kind == "card" else stream.of("0123456789".replace(valid, "")))
        return digits
    own = script(entity)
    word = _alike(entity + next((c for c in entity if c.isalpha()), "x") * more, stream)
    consonants, _, female = letters(own)
    if own in ALPHABETS and kind == "given_f":
        word = word[:-1] + stream.of(female) if len(word) > 2 else word + stream.of(female)
    elif own in ALPHABETS and kind == "given_m" and word[-1] not in consonants:
        word = word[:-1] + stream.of(consonants)
    return word


def rendered(mention: str, kind: str, value: str) -> str:
    """The surrogate in the mention's own form: its separators, or the case of its parts;
    digits beyond the mention's own follow at the end."""
    if kind in ("phone", "social", "card", "account"):
        digits = iter(value)
        return "".join(next(digits) if c.isdigit() else c for c in mention) + "".join(digits)
    if kind == "iban":
        rest = iter(value)
        return "".join(c if c == " " else next(rest) for c in mention)
    if kind in ("email", "ip", "ipv6"):
        return value.upper() if mention.isupper() else value
    if mention.isupper() and len(mention) > 1:
        return value.upper()
    if not mention[:1].isupper():
        return value
    parts, own = re.split("(['’-])", value), re.split("(['’-])", mention)
    return "".join(x[:1].upper() + x[1:] if k >= len(own) or own[k][:1].isupper() else x for k, x in enumerate(parts))


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, entity, surrogate with distinct surrogates; ``entities`` has distinct rows.

    An entity whose surrogate an earlier one has, or that is itself an entity, draws again;
    each round stores all entities once, which are few against their mentions."""

    @F.pandas_udf("string")
    def draw(kind: pd.Series, entity: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(n) else surrogate(k, e, int(n), key) for k, e, n in zip(kind, entity, attempt)], dtype=object)

    # Kinds of one form are told apart by form alone, so names share one space.
    space = F.when(F.col("kind").rlike("^(given|surname)"), "name").otherwise(F.col("kind"))
    now = kept(entities.withColumn("space", space).withColumn("attempt", F.lit(0)).withColumn("surrogate", draw("kind", "entity", "attempt")))
    real = now.select("space", F.col("entity").alias("surrogate"), F.lit(True).alias("real")).distinct()
    while True:
        owner = now.groupBy("space", "surrogate").agg(F.min(F.struct("attempt", "kind", "entity")).alias("owner"))
        judged = now.join(owner, ["space", "surrogate"]).join(real, ["space", "surrogate"], "left")
        mine = (F.col("owner.kind") == F.col("kind")) & (F.col("owner.entity") == F.col("entity"))
        again = ~mine | F.coalesce("real", F.lit(False))
        moved = judged.select("kind", "entity", "space", (F.col("attempt") + again.cast("int")).alias("attempt"), F.col("surrogate").alias("_old"), again.alias("again"))
        drawn = F.coalesce(draw("kind", "entity", F.when(F.col("again"), F.col("attempt"))), "_old")
        now = kept(moved.select("kind", "entity", "space", "attempt", "again", drawn.alias("surrogate")))
        if not now.filter("again").limit(1).count():
            return now.select("kind", "entity", "surrogate")


def pseudonymize(df: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with surrogates in its text, and ``mentions``: kind, start, end in the old text."""
    if not key:
        raise ValueError("surrogates need a secret key")

    def work(column: pa.Array) -> list[pa.Array]:
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("entity", pa.string())]))
        return [pa.array([mentions(t or "") for t in column.to_pylist()], kinds)]

    own_id, own_key, own_list = spare(df, "_id", "_key", "_m")
    plain_id = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))
    keyed = df.withColumn(own_id, plain_id).withColumn(own_key, F.xxhash64(text))
    narrow = keyed.select(F.col(own_id).alias("_id"), F.col(own_key).alias("_key"), F.col(text).alias("_text"))
    found = map_slices(narrow, "_text", [("m", MENTION)], lambda: work, ["_id", "_key"]).filter(F.size("m") > 0)
    found = kept(found.select("_id", "_key", F.explode("m").alias("m")).select("_id", "_key", "m.*").distinct())
    names = assign(found.select("kind", "entity").distinct(), key)
    told = found.join(names, ["kind", "entity"]).groupBy("_id", "_key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", "surrogate"))).alias("_m"))
    told = kept(told.select(F.col("_id").alias(own_id), F.col("_key").alias(own_key), F.col("_m").alias(own_list)))
    told = F.broadcast(told) if (told.agg(F.sum(F.size(own_list))).first()[0] or 0) <= BROADCAST_MENTIONS else told
    joined = keyed.join(told, [own_id, own_key], "left")
    columns = [c for c in df.columns if c.lower() != "mentions"]
    parts = T.ArrayType(T.StructType(MENTION.elementType.fields[:3]))
    schema = T.StructType([*(df.schema[c] for c in columns), T.StructField("mentions", parts)])

    def replace(batches):
        for batch in batches:
            at = batch.schema.names.index(text)
            out, lists = [], batch.column(own_list).to_pylist()
            for t, m in zip(batch.column(at).to_pylist(), lists):
                if m:
                    pieces, end = [], 0
                    for x in m:
                        pieces += [t[end : x["start"]], rendered(t[x["start"] : x["end"]], x["kind"], x["surrogate"])]
                        end = x["end"]
                    t = "".join([*pieces, t[end:]])
                out.append(t)
            cells = list(batch.columns[:-1])
            cells[at] = pa.array(out, pa.string())
            kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            cells.append(pa.array([[{c: x[c] for c in ("kind", "start", "end")} for x in m or ()] for m in lists], kinds))
            yield pa.RecordBatch.from_arrays(cells, names=[*columns, "mentions"])

    return joined.select(*columns, own_list).mapInArrow(replace, schema)


def pii_digest(df: DataFrame, key: bytes) -> DataFrame:
    """doc_id, n_mentions, mentions (kind:start:end), text (with surrogates), text_sha256."""
    done = pseudonymize(df.select("doc_id", "text"), key)
    told = F.array_join(F.transform("mentions", lambda m: F.concat_ws(":", m["kind"], m["start"], m["end"])), ",")
    return done.select("doc_id", F.size("mentions").cast("long").alias("n_mentions"), told.alias("mentions"), "text", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
