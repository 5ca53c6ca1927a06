"""Rules over neighbouring units and whole documents: dates under a birth label, addresses that go on in
the next unit, single characters left beside a code, codes that a document's people decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.address import TAIL
from ..functions.patterns import CODE, DATE, TOKEN
from .mask import UNIT
from .registry import HONORIFIC, dictionary


def with_previous(units: DataFrame, text: str = "text") -> DataFrame:
    """Add before: the text of the unit directly before in the same part, null if there is none."""
    w = W.partitionBy("doc_id", "part_no").orderBy("seq")
    return units.withColumn("before", F.when(F.lag("seq").over(w) == F.col("seq") - 1, F.lag(text).over(w)))


def birth_dates_after_label(units: DataFrame) -> DataFrame:
    """Dates at the start of a unit whose previous unit ends with the birth label: UNIT, st, len, orig."""
    rows = with_previous(units).filter(F.col("before").rlike(r"生年月日[：:\s　]*$"))
    found = F.regexp_extract("text", rf"^[\s　]*({DATE})", 1)
    head = F.length(F.regexp_extract("text", r"^[\s　]*", 0))
    return rows.select(*UNIT, head.alias("st"), F.length(found).alias("len"), found.alias("orig")).filter("orig <> ''")


def address_continuations(units: DataFrame, text: str = "masked") -> DataFrame:
    """Units that start with a building or room while the unit before ends with an address code: UNIT,
    base_code, st, len, orig."""
    rows = with_previous(units, text).withColumn("base_code", F.regexp_extract("before", r"(【住所[0-9]{3,}[^【】]*】)[\s　]*$", 1)).filter("base_code <> ''")
    found = F.regexp_extract(F.concat(F.lit(" "), F.ltrim(text)), f"^{TAIL}", 0)
    return rows.select(*UNIT, "base_code", (F.length(text) - F.length(F.ltrim(text))).alias("st"), (F.length(found) - 1).alias("len"), F.ltrim(found).alias("orig")).filter("orig <> ''")


def single_characters(units: DataFrame, registry: DataFrame, text: str = "masked") -> DataFrame:
    """Surnames or given names of one character that stand alone in a unit or directly beside a name's
    code, at most three separators away: UNIT, st, orig."""
    ones = dictionary(registry).filter((F.length("surface") == 1) & F.col("space").isin("姓", "下")).select("surface").distinct()
    kanji, gap = r"[\p{IsHan}]", r"[ 　・,，、]{0,3}"
    shapes = (rf"^[\s　]*({kanji})[\s　]*$", rf"{CODE}{gap}({kanji})(?![\p{{IsHan}}\p{{IsHiragana}}])", rf"(?<!\p{{IsHan}})({kanji}){gap}{CODE}", rf"(?<!\p{{IsHan}})({kanji})[ 　]?{HONORIFIC}")
    rows = units.select(*UNIT, text, F.explode(F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(s), F.lit(1)) for s in shapes]))).alias("surface"))
    return rows.join(ones, "surface", "left_semi").select(*UNIT, (F.instr(text, F.col("surface")) - 1).alias("st"), F.col("surface").alias("orig"))


def appearing(spans: DataFrame) -> DataFrame:
    """doc_id, person and kind of the people whose full name stands in a document."""
    return spans.filter(F.col("space") == "名").select("doc_id", "person", F.col("kind")).distinct()


def sole_bearers(spans: DataFrame, people: DataFrame) -> DataFrame:
    """doc_id, surname and the one appearing person that bears it, so that a surname alone gets that
    person's code. people: person, surname."""
    there = appearing(spans).join(people, "person")
    by = there.groupBy("doc_id", "surname").agg(F.count_distinct("person").alias("n"), F.min("person").alias("person"))
    return by.filter("n = 1").drop("n")


def preferred(spans: DataFrame, owners: DataFrame, people: DataFrame) -> DataFrame:
    """doc_id, surface and the person meant by a surface that several share: the only one of them who
    appears with full name, or is family of an appearing user with the same surname. owners: surface,
    person, kind."""
    there = appearing(spans)
    users = there.filter(F.col("kind") == "利用者").join(people, "person").select("doc_id", "surname").distinct()
    family = owners.filter(F.col("kind") == "家族").join(people, "person").join(users, "surname").select("doc_id", "surface", "person")
    direct = owners.select("surface", "person").join(there.select("doc_id", "person"), "person").select("doc_id", "surface", "person")
    both = direct.unionByName(family).distinct()
    shared = owners.groupBy("surface").agg(F.count_distinct("person").alias("n")).filter("n > 1").select("surface")
    by = both.join(shared, "surface", "left_semi").groupBy("doc_id", "surface").agg(F.count("*").alias("n"), F.min("person").alias("person"))
    return by.filter("n = 1").drop("n")


def readings_of_people(units: DataFrame, mentions: DataFrame, within: int = 3) -> DataFrame:
    """Readings in furigana fields and the person they belong to: the nearest mention, a later unit before
    an earlier one."""
    from .registry import nearest_person

    reading = F.regexp_extract("text", r"(?:フリガナ|ふりがな)[：: 　]*([\p{IsKatakana}\p{IsHiragana}ー 　]{2,})", 1)
    rows = units.select("doc_id", "seq", F.trim(reading).alias("reading")).filter("reading <> ''")
    return rows.join(nearest_person(rows.select("doc_id", "seq"), mentions, within), ["doc_id", "seq"])


def token_owners(codes: DataFrame, book: DataFrame, registry: DataFrame, most: int = 8) -> DataFrame:
    """Registered people behind codes (`code`): those whose name, part or alias is the code's original."""
    spelt = dictionary(registry).select(F.regexp_replace("surface", "[ 　]", "").alias("restore"), "person", "space").distinct()
    met = codes.select("code").distinct().join(book.select("code", F.regexp_replace("restore", "[ 　]", "").alias("restore")), "code").join(spelt, "restore")
    rank = F.when(F.col("space") == "名", 0).when(F.col("space") == "別", 1).otherwise(2)
    best = met.groupBy("code", "person").agg(F.min(rank).alias("rank"))
    return best.withColumn("place", F.row_number().over(W.partitionBy("code").orderBy("rank", "person"))).filter(F.col("place") <= most)


def users_of_documents(units: DataFrame, text: str = "masked", prefix: str = "利用者") -> DataFrame:
    """doc_id and the sorted distinct codes of users in its texts."""
    found = F.regexp_extract_all(text, F.lit(rf"【{prefix}[0-9]{{3,}}"), F.lit(0))
    rows = units.filter(F.col(text).contains(f"【{prefix}")).select("doc_id", F.explode(F.array_distinct(found)).alias("code")).distinct()
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.concat("code", F.lit("】")))).alias("users"))


def set_aside(documents: DataFrame, batch_users: Column) -> DataFrame:
    """Documents (users) none of whose users is in the current batch."""
    return documents.filter((F.size("users") > 0) & ~F.arrays_overlap("users", batch_users))


def boxes(suspects: DataFrame) -> DataFrame:
    """Suspects of a document for one person to judge: of words with the same context (codes made equal)
    a word contained in a longer one is dropped; owners are counted."""
    core = F.regexp_replace("context", TOKEN, "【】")
    by = suspects.withColumn("core", core).groupBy("doc_id", "core").agg(F.array_distinct(F.collect_list("word")).alias("words"), F.count("*").alias("n"))
    longest = F.filter("words", lambda w: ~F.exists("words", lambda o: (o != w) & o.contains(w)))
    return by.select("doc_id", "core", F.explode(longest).alias("word"), "n")


def board(requests: DataFrame, done: int = 3, log: int = 10) -> DataFrame:
    """Work board of requests (job, state, at): jobs by state with their newest entries, the newest
    `done` finished and the newest `log` others of each job."""
    finished = F.col("state") == "済"
    w = W.partitionBy("job", finished.cast("int")).orderBy(F.desc("at"))
    rows = requests.withColumn("place", F.row_number().over(w))
    return rows.filter((finished & (F.col("place") <= done)) | (~finished & (F.col("place") <= log)))
