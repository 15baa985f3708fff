"""Keyed, type-consistent surrogates for personal data, in DataFrame functions only.

Entities are found by one alternation of patterns. Each distinct entity gets a replacement made
from a keyed hash (HMAC-SHA-256): characters keep their class, case, script and place; numbers keep
their length and punctuation (and a valid check digit stays valid); given names keep their gender.
The same entity gets the same surrogate wherever and however it is written, and collision rounds
give different entities different surrogates that are not themselves an entity of the corpus.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import materialised, spread, table

_MALE = "Mr|Herr|Monsieur|Señor|Sr|Signor|Don|господин|г-н|κύριος|κύριο|السيد|מר|श्री"
_FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Signora|Doña|госпожа|г-жа|κυρία|السيدة|גברת|श्रीमती"
_NEUTRAL = "Dr|Prof|Mx|my name is|My name is|ich heiße|Ich heiße|je m'appelle|Je m'appelle|me llamo|Me llamo|меня зовут|Меня зовут"
_TITLES = "|".join((_MALE, _FEMALE, _NEUTRAL))
#: A name: capitalised where the script has capitals.
_NAME = r"[\p{Lu}\p{Lo}][\p{L}\p{M}'-]{0,62}"

#: Kinds of entity with their patterns, in order: where several match, the first takes it. All
#: repetitions of groups are bounded, so that no text can exhaust the matcher's stack.
KINDS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,126}[A-Za-z]{2,24}(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\w)"),
    ("secret", r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![A-Za-z0-9])"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?!\d)"),
    ("card", r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"),
    ("name", rf"(?<![\p{{L}}\p{{M}}])(?:{_TITLES})\.? {_NAME}(?: {_NAME})?"),
)
_ANY = "|".join(f"(?:{p})" for _, p in KINDS)
#: What a text must have one of for the patterns to be tried: every pattern implies it.
_GATE = rf"[0-9]{{3}}|@|\d\.\d|[0-9A-Fa-f]{{32}}|AKIA[0-9A-Z]|gh[opsu]_|sk-[A-Za-z0-9]|[A-Z]{{2}}\d{{2}} ?[A-Z0-9]|(?<![\p{{L}}\p{{M}}])(?:{_TITLES})\.? "

# Given names by gender and script, from which surrogates are drawn, and syllables of surnames.
NAMES = {
    ("m", "latin"): "Adam Alan Brian Carl Colin David Eric Felix Frank Gavin Henry Hugo Ian Jack Joel Karl Leo Louis Mark Neil Oscar Paul Peter Ralph Simon Tom Victor Walter",
    ("f", "latin"): "Alice Amy Anna Beth Carla Clara Diana Emma Erica Flora Grace Helen Irene Jane Judith Karen Laura Lucy Maria Nina Olivia Paula Rosa Sarah Sofia Teresa Vera Wendy",
    ("n", "latin"): "Alex Andrea Ariel Blake Cameron Charlie Dana Drew Eden Ellis Frances Jamie Jordan Kai Kim Lee Logan Morgan Noel Parker Quinn Robin Rowan Sam Sasha Sky Taylor Toni",
    ("m", "cyrillic"): "Алексей Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Сергей",
    ("f", "cyrillic"): "Алина Анна Вера Галина Дарья Елена Жанна Ирина Ксения Лариса Мария Нина Ольга Полина Светлана Татьяна",
    ("n", "cyrillic"): "Женя Саша Валя Слава Паша Тоня",
    ("m", "greek"): "Γιώργος Νίκος Κώστας Πέτρος Παύλος Μάριος Στέλιος Ανδρέας",
    ("f", "greek"): "Μαρία Ελένη Άννα Σοφία Ειρήνη Κατερίνα Δήμητρα Χριστίνα",
    ("n", "greek"): "Άρτεμη Χάρι Κίνα Νάντι",
    ("m", "arabic"): "أحمد خالد يوسف عمر سامر كريم ماجد طارق",
    ("f", "arabic"): "ليلى سلمى هدى مريم نادية رانيا سارة منى",
    ("n", "arabic"): "نور صباح رضا جهاد",
    ("m", "hebrew"): "דוד יוסף משה אבי רון אורי גיל דן",
    ("f", "hebrew"): "שרה רחל לאה מרים רות תמר דנה יעל",
    ("n", "hebrew"): "טל עדי שי ליאור",
    ("m", "devanagari"): "राम मोहन विजय अमित राहुल सुनील अनिल रवि",
    ("f", "devanagari"): "सीता गीता मीना सुनीता अनीता कविता रेखा पूजा",
    ("n", "devanagari"): "किरण ज्योति शशि सुमन",
    ("m", "han"): "伟 强 军 磊 勇 杰 涛 明",
    ("f", "han"): "芳 娜 敏 静 丽 艳 娟 霞",
    ("n", "han"): "宁 文 华 平",
}
_SYLLABLES = {
    "latin": "ba be bo da de do fa ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo za",
    "cyrillic": "ба бе бо ва ве го да до ка ке ко ла ле ло ма ми мо на не но ра ре ро са се со та те то ха шо ша",
    "greek": "βα βε γα δα δε κα κε κο λα λε λο μα με μο να νε νο πα πε πο ρα ρε ρο σα σε σο τα τε το φα φε χα",
    "arabic": "با دا را زا سا شا كا لا ما نا هم رن سل تم كر جد",
    "hebrew": "בא דא גל הר ול זן חן טל כר לב מן נר סל פר צר שר",
    "devanagari": "का खा गा चा जा टा डा ता दा ना पा बा मा या रा ला",
    "han": "王 李 张 刘 陈 杨 赵 黄 周 吴 徐 孙 胡 朱 高 林",
}
#: Scripts as the matcher names them; any other counts as Latin.
_SCRIPTS = {"cyrillic": "IsCyrillic", "greek": "IsGreek", "arabic": "IsArabic", "hebrew": "IsHebrew", "devanagari": "IsDevanagari", "han": "IsHan"}
_ALPHABETS = ((r"[0-9]", "0123456789"), (r"[a-z]", "abcdefghijklmnopqrstuvwxyz"), (r"[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
#: Rounds in which candidates keep their form; from then on letters are added to it.
FORMED = 12


def _kind(surface: Column) -> Column:
    """The kind whose pattern matches the whole of an entity."""
    out = F.lit("name")
    for name, pattern in reversed(KINDS[:-1]):
        bare = pattern.split(")", 1)[1] if pattern.startswith("(?<!") else pattern
        out = F.when(surface.rlike(f"^(?:{bare})$"), F.lit(name)).otherwise(out)
    return out


def _pick(items: str, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), F.pmod(n, F.lit(len(items))) + 1)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    return F.aggregate(
        F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))),
        F.lit(0), lambda a, x: a + x,
    ) % 10 == 0


def hmac_sha256(key: bytes, message: Column) -> Column:
    """64 hex digits of the HMAC-SHA-256 of a binary column."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    inner, outer = (bytes(b ^ x for b in key.ljust(64, b"\0")) for x in (0x36, 0x5C))
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), message), 256))), 256)


def _numbers(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """Pseudo-random numbers of an entity and attempt: one of 16 bits for each of its characters, and
    32 more, as an array. Sixteen come from each HMAC, of kind, attempt, block and normal form."""
    message = lambda b: F.encode(F.concat(kind, F.lit("\0"), attempt.cast("string"), F.lit("\0"), b.cast("string"), F.lit("\0"), norm), "utf-8")
    digests = F.transform(F.sequence(F.lit(0), F.floor(F.length(norm) / 16).cast("int") + 2), lambda b: hmac_sha256(key.encode(), message(b)))
    return F.flatten(F.transform(digests, lambda d: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substring(d, i * 4 + 1, F.lit(4)), 16, 10).cast("int"))))


def _like(text: Column, numbers: Column) -> Column:
    """Text in which each letter and digit is replaced by one of its class."""
    hexed = text.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$")

    def one(c: Column, i: Column) -> Column:
        n, out = F.get(numbers, i), c
        for pattern, letters in reversed(_ALPHABETS):
            out = F.when(c.rlike(pattern), _pick(letters, n)).otherwise(out)
        return F.when(hexed & c.rlike("[a-f]"), _pick("abcdef", n)).when(hexed & c.rlike("[A-F]"), _pick("ABCDEF", n)).otherwise(out)

    return F.array_join(F.transform(_chars(text), one), "")


def _surrogate(kind: Column, norm: Column, attempt: Column, numbers: Column) -> Column:
    """The attempt-th candidate for an entity."""
    like = _like(norm, numbers)
    size = F.size(numbers)
    n = lambda i: F.get(numbers, size - 1 - i)  # noqa: E731  from the end, beyond those that characters use
    letters = F.concat(*[_pick("abcdefghijklmnopqrstuvwxyz", n(20 + i)) for i in range(4)])
    # Crowded forms (a one-letter mailbox, a number whose digits are used up) grow by letters in the end.
    grown = F.when(attempt < FORMED, F.lit("")).otherwise(letters)
    at = F.instr(norm, "@")
    host = F.substring(norm, at + 1, F.length(norm))
    dot = F.instr(host, ".")
    email = F.concat(F.substring(like, F.lit(1), at - 1), F.when(attempt < 6, F.lit("")).otherwise(letters), F.lit("@"), F.substring(like, at + 1, dot - 1), F.substring(host, dot, F.length(host)))
    ip = F.concat_ws(".", (1 + F.pmod(n(1), F.lit(223))).cast("string"), *[F.pmod(n(i), F.lit(256)).cast("string") for i in (2, 3, 4)])
    head = F.substring(like, F.lit(1), F.length(norm) - 1)
    checked = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.when(_luhn(F.concat(head, d.cast("string"))), d)))
    card = F.when(_luhn(norm), F.concat(head, checked.cast("string"))).otherwise(like)
    phone = F.concat(F.substring(norm, 1, 1), F.substring(like, F.lit(2), F.length(like)))
    iban = F.concat(F.substring(norm, 1, 2), F.substring(like, F.lit(3), F.length(like)))
    prefix = F.regexp_extract(norm, r"^(AKIA|gh[opsu]_|sk-|)", 1)
    secret = F.concat(prefix, F.substring(like, F.length(prefix) + 1, F.length(like)))
    script = F.lit("latin")
    for s, block in _SCRIPTS.items():
        script = F.when(norm.rlike(rf"\p{{{block}}}"), s).otherwise(script)
    drawn = lambda words, i: F.element_at(words, F.pmod(n(i), F.size(words)) + 1)
    syllables = lambda count, s: F.concat(*[drawn(F.split(F.lit(_SYLLABLES[s]), " "), 8 + i) for i in range(count)])
    given, surname = F.lit(None).cast("string"), F.lit(None).cast("string")
    for s in _SYLLABLES:
        long = F.when(attempt < FORMED, syllables(5, s)).otherwise(syllables(10, s))
        tail = F.when(attempt < 3, "").when(attempt < 6, F.concat(F.lit("-"), F.initcap(syllables(3, s)))).otherwise(F.concat(F.lit("-"), F.initcap(long)))
        for g in "mfn":
            given = F.when((script == s) & (kind == f"given_{g}"), F.concat(drawn(F.split(F.lit(NAMES[(g, s)]), " "), 5), tail)).otherwise(given)
        surname = F.when(script == s, F.initcap(F.when(attempt < 5, syllables(4, s)).when(attempt < FORMED, syllables(6, s)).otherwise(syllables(10, s)))).otherwise(surname)
    return (
        F.when(kind == "email", email).when(kind == "ip", F.concat(ip, grown)).when(kind == "card", F.concat(card, grown)).when(kind == "phone", F.concat(phone, grown))
        .when(kind == "iban", F.concat(iban, grown)).when(kind == "secret", F.concat(secret, grown)).when(kind.startswith("given"), given).when(kind == "surname", surname)
        .otherwise(F.concat(like, grown))
    )


def _units(surface: Column, kind: Column) -> Column:
    """What an entity consists of: structs of kind and normal form. A name has a surname and maybe
    a given name, each of which stays the same in other names; all other kinds are one unit."""
    digits = F.regexp_replace(surface, r"[^0-9]", "")
    norm = (
        F.when(kind == "email", F.lower(surface)).when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(surface, " ", "")).otherwise(surface)
    )
    title = F.regexp_extract(surface, rf"^({_TITLES})\.? ", 1)
    gender = F.when(title.rlike(f"^(?:{_MALE})$"), "m").when(title.rlike(f"^(?:{_FEMALE})$"), "f").otherwise("n")
    words = F.split(F.regexp_replace(surface, rf"^(?:{_TITLES})\.? ", ""), " ")
    last = F.struct(F.lit("surname").alias("kind"), F.element_at(words, -1).alias("norm"))
    first = F.struct(F.concat(F.lit("given_"), gender).alias("kind"), F.element_at(words, 1).alias("norm"))
    return F.when(kind != "name", F.array(F.struct(kind.alias("kind"), norm.alias("norm")))).when(F.size(words) > 1, F.array(first, last)).otherwise(F.array(last))


def _rendered(surface: Column, kind: Column, units: Column) -> Column:
    """An entity as its surface writes it, with its units' surrogates in place: e-mail addresses keep
    capitals, numbers their punctuation. What a surrogate has grown by stands at the end."""
    only = F.element_at(units, 1)
    chars = _chars(surface)
    before = lambda i, c: F.length(F.regexp_replace(F.array_join(F.slice(chars, F.lit(1), i + 1), ""), c, ""))
    rest = lambda c: F.substring(only, F.length(F.regexp_replace(surface, c, "")) + 1, F.length(only))
    digits = F.concat(F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(only, before(i, "[^0-9]"), F.lit(1))).otherwise(c)), ""), rest("[^0-9]"))
    spaced = F.concat(F.array_join(F.transform(chars, lambda c, i: F.when(c != " ", F.substring(only, before(i, " "), F.lit(1))).otherwise(c)), ""), rest(" "))
    cased = F.array_join(F.transform(_chars(only), lambda c, i: F.when(F.coalesce(F.get(chars, i), F.lit("")).rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")
    title = F.regexp_extract(surface, rf"^((?:{_TITLES})\.? )", 1)
    return (
        F.when(kind == "name", F.concat(title, F.array_join(units, " "))).when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "iban", spaced).when(kind == "email", cased).otherwise(only)
    )


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    """In a fixed number of tasks, as the few bytes of an entity hide what its expressions cost."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def surrogate_table(units: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate) of every distinct (kind, norm): all different, and none of them an
    entity of the corpus itself. Rounds go on until no collision is left; in each, the first of
    those that collide keeps its surrogate and the others take their next candidate. Candidates
    keep the entity's form for FORMED rounds and then grow by letters, so that rounds end."""
    base = materialised(units.distinct())
    taken = base.select(F.col("norm").alias("surrogate")).distinct().withColumn("taken", F.lit(True))
    state = base.withColumn("attempt", F.lit(0))
    while True:
        drawn = _dealt(state, "norm").withColumn("numbers", _numbers(key, F.col("kind"), F.col("norm"), F.col("attempt")))
        made = materialised(drawn.withColumn("surrogate", _surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), F.col("numbers"))).drop("numbers"))
        # Rank by surrogate is a min-aggregation and a join, so a crowded surrogate is no window of one task.
        first = made.groupBy("surrogate").agg(F.min(F.struct("attempt", "kind", "norm")).alias("first"))
        told = made.join(first, "surrogate").join(taken, "surrogate", "left")
        clash = F.coalesce("taken", F.lit(False)) | (F.col("first.norm") != F.col("norm")) | (F.col("first.kind") != F.col("kind"))
        told = materialised(told.select("kind", "norm", "surrogate", (F.col("attempt") + clash.cast("int")).alias("attempt"), clash.alias("clash")))
        if not told.where("clash").limit(1).count():
            return told.select("kind", "norm", "surrogate")
        state = told.select("kind", "norm", "attempt")


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Replaces the entities in column ``text`` of ``docs`` (with doc_id) by surrogates under ``key``.

    Result: (row, new_text, n_entities), ``row`` being a struct of the other input columns, so no
    column name can clash. Texts of any length are read whole; a null text stays null with 0
    entities, an empty one stays empty; repeated rows are each answered alike; an empty table gives
    an empty result. A kind's pattern decides what an entity is (see KINDS): a name is one only
    after a title or a phrase that introduces it.
    """
    # Two hashes tell texts apart where the replacements meet them again.
    hashes = [F.xxhash64(F.col("doc_id"), F.col(text)).alias("_k"), F.xxhash64(F.lit(7), F.col(text), F.col("doc_id")).alias("_j")]
    texts = docs.select(*hashes, F.col(text).cast("string").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"))
    hits = texts.where(F.col("_text").rlike(_GATE)).select("_k", "_j", F.regexp_extract_all("_text", F.lit(_ANY), F.lit(0)).alias("m")).where("size(m) > 0")
    hits = materialised(hits.groupBy("_k", "_j").agg(F.first("m").alias("m")))
    surfaces = _dealt(hits.select(F.explode("m").alias("surface")).distinct(), "surface")
    seen = materialised(surfaces.withColumn("kind", _kind(F.col("surface"))).withColumn("units", _units(F.col("surface"), F.col("kind"))))
    parts = seen.select("surface", F.posexplode("units").alias("at", "u")).select("surface", "at", "u.kind", "u.norm")
    made = surrogate_table(parts.select("kind", "norm"), key)
    named = parts.join(made, ["kind", "norm"]).groupBy("surface").agg(F.sort_array(F.collect_list(F.struct("at", "surrogate"))).alias("s"))
    written = _dealt(seen.join(named, "surface"), "surface").select("surface", _rendered(F.col("surface"), F.col("kind"), F.col("s.surrogate")).alias("new"))
    written = materialised(written)
    written = F.broadcast(written) if seen.count() <= BROADCAST else written
    placed = hits.select("_k", "_j", F.posexplode("m").alias("at", "surface")).join(written, "surface")
    lists = placed.groupBy("_k", "_j").agg(F.sort_array(F.collect_list(F.struct("at", "new"))).alias("_new"))
    joined = texts.join(lists, ["_k", "_j"], "left")
    rebuilt = F.array_join(F.zip_with(F.split("_text", _ANY, -1), F.col("_new.new"), lambda p, x: F.concat(p, F.coalesce(x, F.lit("")))), "")
    return joined.select("row", F.when(F.col("_new").isNull(), F.col("_text")).otherwise(rebuilt).alias("new_text"), F.coalesce(F.size("_new"), F.lit(0)).alias("n_entities"))


#: Distinct surfaces up to which their replacements are broadcast: some MB, as a surface is short.
BROADCAST = 1 << 16
#: The key of the registered query where the session sets none; a real run brings its own.
KEY = "lodestone-demo-key"


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for their personal data."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = pseudonymise(docs, spark.conf.get("spark.lodestone.surrogates.key", KEY))
    return found.select("row.doc_id", "n_entities", F.col("new_text").alias("text"))
