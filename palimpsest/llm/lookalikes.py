"""Problem 4: visually identical text with different characters.

Each text is split into plain stretches and short runs of characters that have another form. The distinct runs (few:
the same full-width words, spaces and marks come again and again) are exploded to positioned code points, joined with
the decomposition and look-alike mappings and with the combining classes, put in canonical order, recomposed and
rebuilt; the texts then take their runs' forms by a join and are put together again. So the mapping work grows with
the distinct runs, and the texts are shuffled once.

What looks the same: full-width, half-width and ordinary forms; spaces of any kind (line ends stay line ends);
composed and decomposed accents; compatibility ideographs and radicals and the ideographs they depict; ligatures;
Cyrillic and Greek letters drawn like Latin ones; hyphens; text with and without characters of no width. Letter case,
accents and raised or lowered figures stay different. Conjoining Hangul jamo are left as they are.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.plans.session import cut, discard, small, table

RUN_CHARS = 32
_MARK = "\x01"
MAX_BROADCAST_RUNS = 100_000

# Letters and signs that are drawn alike, each row a script's characters over the Latin ones.
LOOKALIKES = {
    "Cyrillic small": ("аеорсухѕіјһԁԛԝѵ", "aeopcyxsijhdqwv"),
    "Cyrillic capital": ("АВЕКМНОРСТУХЅІЈԌԚԜ", "ABEKMHOPCTYXSIJGQW"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϳ", "ABEZHIKMNOPTYXovj"),
    "Armenian": ("զհոսցօԼՏՕ", "qhnugoLSO"),
    "Cherokee": ("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᏀᏃᏎᏔᏙᏚᏞᏟᏢᏦᏧᏴ", "DRTiAJEWMHGZ4WVSLCPKdB"),
    "Lisu": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    "hyphens": ("‐‑", "--"),
    "radicals": (
        "⺁⺄⺈⺊⺌⺎⺒⺓⺕⺜⺝⺠⺧⺪⺫⺬⺮⺶⺹⺻⺼⺽⻁⻄⻅⻆⻉⻊⻋⻑⻓⻔⻗⻘⻙⻚⻛⻜⻝⻡⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻮⻰⻱",
        "厂乙刀卜小兀巳幺彐日月民牛疋目示竹羊耂聿月臼虎西见角贝足车長长门雨青韦页风飞食首马骨鬼鱼鸟卤麦黄黾斉齐齿龙龜",
    ),
}

# Ranges of compatibility characters drawn like what they decompose to.
_SAME_COMPAT = ((0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0xB5, 0xB5), (0x2024, 0x2026), (0x2160, 0x217F), (0x2E80, 0x2FDF), (0xFB00, 0xFB06))
_HANGUL = range(0xAC00, 0xD7A4)
# Tags and ideographic variation selectors; between the ideographs and these nothing is assigned that is replaced.
_LAST = range(0xE0000, 0xE01F0)


def _form(c: int) -> str | None:
    """What a code point is replaced by, decomposed; None if by itself."""
    ch = chr(c)
    if c in (0x9, 0x3164, 0x2800) or unicodedata.category(ch) == "Zs":
        return None if c == 0x20 else " "
    if unicodedata.category(ch) == "Cf" or 0xFE00 <= c <= 0xFE0F or c in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5) or 0xE0100 <= c <= 0xE01EF:
        return ""
    if c in _HANGUL or 0xD800 <= c <= 0xDFFF:
        return None
    kind, _, parts = unicodedata.decomposition(ch).rpartition("> ") if "<" in unicodedata.decomposition(ch) else ("", "", unicodedata.decomposition(ch))
    if not parts:
        return None
    if kind in ("", "<wide", "<narrow", "<noBreak") or kind == "<compat" and any(a <= c <= b for a, b in _SAME_COMPAT):
        return "".join(_form(int(p, 16)) or chr(int(p, 16)) for p in parts.split())
    return None


@cache
def mapping() -> dict[str, str]:
    """Every code point that is replaced, and by what, by rule from the character database and the fixed look-alikes."""
    alike = {a: b for row in LOOKALIKES.values() for a, b in zip(*row, strict=True)}
    forms = {chr(c): f for c in (*range(0x80, 0x30000), *_LAST) if (f := _form(c)) is not None} | {"\t": " "}
    return alike | {a: "".join(alike.get(x, x) for x in f) for a, f in forms.items()}


@cache
def _marks() -> frozenset[int]:
    """Combining marks, and characters whose form begins with one."""
    return frozenset({c for c in (*range(0x300, 0x30000), *_LAST) if unicodedata.category(chr(c))[0] == "M"} | {ord(c) for c, form in mapping().items() if form and unicodedata.combining(form[0])})


def _ranges(chosen: frozenset[int]) -> str:
    """Code points as the inside of a regular expression's class."""
    codes = sorted(chosen)
    out, start, last = [], codes[0], codes[0]
    for c in [*codes[1:], -1]:
        if c != last + 1:
            out.append(f"\\x{{{start:x}}}-\\x{{{last:x}}}")
            start = c
        last = c
    return "".join(out)


@cache
def run_pattern() -> str:
    """A run: replaced characters and marks, with the letter before if a mark follows, and never ending before a mark."""
    # The first, small set decides for most characters; ASCII and the plain ideographs fail there.
    outer = "\\t\\x{80}-\\x{2fff}\\x{3000}-\\x{33ff}\\x{a000}-\\x{10ffff}"
    gone = frozenset(ord(c) for c, form in mapping().items() if not form)
    special = f"[{outer}&&[{_ranges(frozenset(map(ord, mapping())) | _marks())}]]"
    mark, weightless = f"[{outer}&&[{_ranges(_marks())}]]", f"[{outer}&&[{_ranges(_marks() | gone)}]]"
    return f"(?:(?!{special})[^\\n](?={weightless}*{mark}))?{special}{{1,{RUN_CHARS}}}+{weightless}*+"


def _mapping_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(mapping().items()), "ch string, form string")


def _class_table(spark: SparkSession) -> DataFrame:
    """(mark, ccc) of every character with a combining class."""
    return spark.createDataFrame([(chr(c), unicodedata.combining(chr(c))) for c in range(0x300, 0x20000) if unicodedata.combining(chr(c))], "cp string, ccc int")


@cache
def _pairs() -> dict[str, str]:
    """Starter and mark to the composed character."""
    out = {}
    for c in range(0xC0, 0x30000):
        d = unicodedata.decomposition(chr(c))
        if d and "<" not in d and len(d.split()) == 2:
            pair = "".join(chr(int(p, 16)) for p in d.split())
            if unicodedata.normalize("NFC", pair) == chr(c) and unicodedata.combining(pair[1]):
                out[pair] = chr(c)
    return out


def run_forms(runs: DataFrame) -> DataFrame:
    """(run, form) of distinct runs (run): map, order, recompose, rebuild."""
    spark = runs.sparkSession
    every = lambda s: F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))
    points = runs.select(F.xxhash64("run").alias("k"), "run", F.posexplode(every(F.col("run"))).alias("pos", "ch")).drop("run")
    mapped = points.join(F.broadcast(_mapping_table(spark)), "ch", "left").select("k", "pos", F.coalesce("form", "ch").alias("form"))
    single = mapped.select("k", "pos", F.posexplode(every(F.col("form"))).alias("sub", "cp"))
    classed = single.join(F.broadcast(_class_table(spark)), "cp", "left").fillna(0, ["ccc"])
    # Marks sort by class behind the starter they follow; equal classes keep their order.
    place = Window.partitionBy("k").orderBy("pos", "sub")
    ordered = classed.withColumn("starter", F.sum((F.col("ccc") == 0).cast("int")).over(place))
    lists = ordered.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("starter", "ccc", "pos", "sub", "cp"))).alias("x"))
    pairs = F.from_json(F.lit(json.dumps(_pairs())), "map<string,string>")  # a constant

    def step(acc: Column, x: Column) -> Column:
        free = (acc["last"] == 0) | (acc["last"] < x["ccc"])
        whole = F.when((x["ccc"] > 0) & free, F.element_at(pairs, F.concat(acc["base"], x["cp"])))
        state = lambda done, base, marks, last: F.struct(done.alias("done"), base.alias("base"), marks.alias("marks"), last.alias("last"))
        return (
            F.when(x["ccc"] == 0, state(F.concat(acc["done"], acc["base"], acc["marks"]), x["cp"], F.lit(""), F.lit(0)))
            .when(whole.isNotNull(), state(acc["done"], whole, acc["marks"], acc["last"]))
            .otherwise(state(acc["done"], acc["base"], F.concat(acc["marks"], x["cp"]), x["ccc"]))
        )

    empty = F.struct(F.lit("").alias("done"), F.lit("").alias("base"), F.lit("").alias("marks"), F.lit(0).alias("last"))
    join = lambda acc: F.concat(acc["done"], acc["base"], acc["marks"])
    forms = lists.select("k", F.aggregate("x", empty, step, join).alias("form"))
    # A run of weightless characters only has no code points left.
    return runs.withColumn("k", F.xxhash64("run")).join(forms, "k", "left").select("run", F.coalesce("form", F.lit("")).alias("form"))


def looks(values: DataFrame) -> DataFrame:
    """(field, id, raw, form) of ``values`` (field, id, text): the hash of each text and its one consistent form.

    Null texts and ids are left out, an empty text has an empty form. Repeated rows give one row; one id with several
    texts gives a row for each.
    """
    pattern = run_pattern()
    # One search marks the runs, then the text falls apart at the marks: plain, run, plain, run, ..., plain. A text that
    # holds the mark itself is taken apart by two searches.
    marked = F.split(F.regexp_replace("text", f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK, -1)
    plains, runs = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    paired = F.flatten(F.transform(F.arrays_zip(plains.alias("p"), runs.alias("r")), lambda x: F.array(x["p"], F.coalesce(x["r"], F.lit("")))))
    kept = values.where("id is not null and text is not null")
    # Kept as a table: the search is the dearest step, and both the distinct runs and the pieces come from it.
    rows = cut(kept.select("field", "id", F.xxhash64("text").alias("raw"), F.when(F.col("text").contains(_MARK), paired).otherwise(marked).alias("parts")))
    seen = rows.select(F.explode(F.array_distinct(F.filter("parts", lambda x, i: (i % 2 == 1) & (x != "")))).alias("run"))
    forms = cut(run_forms(seen.distinct()))
    pair = F.transform(F.sequence(F.lit(0), F.floor((F.size("parts") - 1) / 2).cast("int")), lambda i: F.struct(F.get("parts", 2 * i).alias("plain"), F.get("parts", 2 * i + 1).alias("run")))
    pieces = rows.select("field", "id", "raw", F.posexplode(pair).alias("pos", "x")).select("field", "id", "raw", "pos", "x.plain", "x.run")
    mapped = pieces.join(small(forms, MAX_BROADCAST_RUNS), "run", "left").select("field", "id", "raw", F.struct("pos", F.concat("plain", F.coalesce("form", F.lit(""))).alias("t")).alias("p"))
    built = mapped.groupBy("field", "id", "raw").agg(F.array_sort(F.collect_set("p")).alias("p"))
    return built.select("field", "id", "raw", F.array_join("p.t", "").alias("form"))


def _members(values: DataFrame) -> DataFrame:
    """(field, look, raw, id) of the values that look like a value written with other characters, as a table."""
    keyed = cut(looks(values).select("field", "id", "raw", F.sha2("form", 256).alias("look")).distinct())
    mixed = keyed.groupBy("field", "look").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).where("a < b").select("field", "look")
    members = cut(keyed.join(mixed, ["field", "look"]).select("field", "look", "raw", "id"))
    discard(keyed)
    return members


def alike_pairs(values: DataFrame) -> DataFrame:
    """(field, id_a, id_b): pairs of different ids of a field whose texts look the same but differ in their code points.

    The spellings of a look meet first, then their records, so that no pair of records with the same spelling is made:
    the rows in between are those of the result. For one row per record instead of pairs see ``alike_classes``.
    """
    members = _members(values)
    spellings = members.select("field", "look", "raw").distinct()
    two = spellings.withColumnRenamed("raw", "raw_a").join(spellings.withColumnRenamed("raw", "raw_b"), ["field", "look"]).where("raw_a < raw_b")
    side = lambda x: members.select("field", "look", F.col("raw").alias(f"raw_{x}"), F.col("id").alias(x))
    pairs = two.join(side("a"), ["field", "look", "raw_a"]).join(side("b"), ["field", "look", "raw_b"]).where("a <> b")
    return pairs.select("field", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def alike_classes(values: DataFrame) -> DataFrame:
    """(field, id, class_id, records, spellings): each record that looks like one written with other characters.

    ``class_id`` is the least id of its look, ``records`` and ``spellings`` count the look's ids and different texts. An
    id with several texts has a row for each class it is in.
    """
    members = _members(values)
    spelled = members.groupBy("field", "look", "raw").agg(F.min("id").alias("first"))
    classes = members.groupBy("field", "look").agg(F.min("id").alias("class_id"), F.count_distinct("id").alias("records"))
    classes = classes.join(spelled.groupBy("field", "look").agg(F.count("*").alias("spellings")), ["field", "look"])
    return members.select("field", "look", "id").distinct().join(classes, ["field", "look"]).select("field", "id", "class_id", "records", "spellings")


def _values(spark: SparkSession, base: str) -> DataFrame:
    fields = ["title", "normalized_title", "normalized_names"]
    # One pass over the table for its three fields.
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]))
    titles = table(spark, base, "source_documents").select(F.col("document_id").alias("id"), pairs.alias("x")).select("x.field", "id", "x.text")
    return titles.unionByName(table(spark, base, "segments").select(F.lit("segment_text").alias("field"), F.col("segment_id").alias("id"), "text"))


def found(spark: SparkSession, base: str) -> DataFrame:
    """p4_found: pairs of records whose values look the same but are not the same code points."""
    return alike_pairs(_values(spark, base)).withColumnRenamed("field", "field_name")


def classes(spark: SparkSession, base: str) -> DataFrame:
    """p4_classes: one row per record whose value is written otherwise elsewhere, with its class."""
    return alike_classes(_values(spark, base)).withColumnRenamed("field", "field_name")


def forms(spark: SparkSession, base: str) -> DataFrame:
    """p4_forms: the consistent form of every title, normalized title, name list and segment text."""
    return looks(_values(spark, base)).select(F.col("field").alias("field_name"), "id", "form").distinct()
