"""Problem 5: noise in text from scanned pages.

Edge lines. The blocks of a page are looked at together: a short line without a closing mark at the top or bottom
edge, a line that stands there on several pages of the document, or one in the margins where the box is known, is
running matter; a number alone in the last line is the page number.

Hyphens. A word cut at a line end goes on in the next line of text, on the page or the next one that has text. Whether
its mark belongs to its spelling is decided by the corpus: how often the word stands elsewhere joined, and how often
hyphenated.

Misread characters. Words of Latin script and three-character windows of Han script are counted over the whole corpus,
blocks that came twice once. A word's anagram hash is the sum of its characters' hashes, so putting one character (or
pair) for another changes it by a fixed difference: adding the differences of the confusable pairs to a rare word's hash
and joining with the hashes of all words finds its frequent variants in one equi-join. They are then checked to differ
in one place only, and ranked by frequency. Which characters are confused is learned from the same counts (see
``learned_confusions``); a short list of known confusions helps where there is too little text to learn from. A Han
character counts as misread if the windows around it have the same frequent variant and none is frequent as it stands.
Blocks that say themselves that they were badly recognised (confidence, risk flags) and show no other noise are believed
at weaker evidence.

Grouping is by page, word or paragraph, never by document; counts are combined before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.codepoints import slices
from palimpsest.operators.temporal import greatest_before, next_by_number
from palimpsest.plans.session import cut, in_arrow, small, table

# Known confusions of scanned characters, Latin script in lower case (right, wrong). Others are learned.
LATIN_CONFUSIONS = [
    ("e", "c"), ("t", "f"), ("o", "0"), ("s", "5"), ("i", "!"), ("l", "1"), ("i", "1"), ("g", "9"), ("b", "6"), ("b", "8"), ("z", "2"),
    ("d", "cl"), ("n", "ri"), ("u", "ii"), ("m", "rn"), ("w", "vv"), ("h", "li"), ("q", "g"), ("c", "e"), ("f", "t"), ("m", "nn"), ("k", "lc"),
    ("cl", "d"), ("ri", "n"), ("ii", "u"), ("rn", "m"), ("vv", "w"), ("li", "h"),
]
# The same for Han script, right before wrong.
HAN_CONFUSIONS = (
    "的旳 人入 理埋 日曰 应庆 期朝 运云 承丞 管菅 保堡 申中 证征 编遍 货贷 单早 仓仑 大犬 未末 持待 更吏 检俭 处外 交文 费贾 封対 由甲 申甲 清淸 已巳 "
    "入人 末未 土士 士土 干千 千干 己已 已己 大太 太大 日目 目日 人八 由田 间问 问间 自白 白自 今令 令今 治冶 师帅 析折 侯候 候侯 拔拨 天夫 力刀 贝见 王玉 主王 木本 休体 买卖 刑型 拆折 密蜜"
).split()

# Heights of a page and of its margins in points. Boxes below that height are on a larger page, whose
# margins are in proportion.
PAGE_HEIGHT, TOP_MARGIN, BOTTOM_MARGIN = 842.0, 52.0, 765.0
SHORT_LINE = 0.6  # of the longest line of the page
REPEATED_PAGES, REPEATED_CHARS = 3, 80  # pages of a document with the same edge line, and the longest such line
LEAST_VARIANT, VARIANT_RATIO = 4, 8
WEAK_VARIANT, WEAK_RATIO = 2, 2  # in blocks that were badly recognised
BAD_CONFIDENCE = 0.8
# Learned confusions: words of Latin script that show one, and how much oftener than the next best reading; windows of
# Han script that show one at each of their three places.
LEAST_WORDS, DOMINANCE, LEAST_WINDOWS = 5, 4, 2
PARAGRAPH_PAGES = 64  # a paragraph over more pages comes in parts

_BLANK = r"[ \x{a0}\x{2000}-\x{200a}\x{202f}]"
_SPACED = rf"(?U)(?<!\w)(?:\w{_BLANK}){{2,}}\w(?!\w)"
_NUMBER = r"(?iU)^[-·.—–\s]*(?:page\s*|第\s*)?(?:[0-9lozibs]*[0-9][0-9lozibs]*|[lo]{1,2}|[ivxlc]+)(?:\s*/\s*[0-9lozibs]+|\s*页)?[-·.—–\s]*$"
_MARKS = "-‐¬­"
_CUT = rf"[\p{{L}}\d!\x{{fffd}}][{_MARKS}]\s*$"
_LETTER = r"[A-Za-z\x{c0}-\x{24f}]"
_TOKEN = r"[A-Za-z\x{c0}-\x{24f}0-9!\x{fffd}]+"


def _bad(confidence: Column, flags: Column) -> Column:
    """The block was badly recognised: its confidence, brought to the unit scale, is low, or a flag says so."""
    unit = F.when(confidence.between(0, 1), confidence).when((confidence > 1) & (confidence <= 100), confidence / 100)
    return F.coalesce(unit < BAD_CONFIDENCE, F.lit(False)) | F.coalesce(F.contains(flags, F.lit("low_confidence")), F.lit(False))


def _optional(blocks: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in blocks.columns else F.lit(None).cast(kind)


def _solid(line: Column) -> Column:
    """The line with letters set apart by blanks put together again."""
    close = F.regexp_replace(line, rf"(?<=(?<!\S)\S){_BLANK}(?=\S(?!\S))", "")
    return F.when(line.rlike(_SPACED), F.regexp_replace(close, rf"{_BLANK}{{2,}}", " ")).otherwise(line)


def page_lines(blocks: DataFrame) -> DataFrame:
    """Lines of scanned blocks, as tables: document_id, page, ordinal, block_id, kind, furniture, bad, line_no, line, next_line, next_block.

    ``furniture`` is running_line, page_number or null; such blocks have one row and no next line. Blocks without page
    or text are no scanned text; blocks delivered twice count once. Blocks without document are each a page of their own.
    """
    at = lambda i: F.get_json_object("bbox_json", f"$[{i}]").try_cast("double")
    owner = F.coalesce("document_id", F.concat(F.lit("?"), "block_id")).alias("document_id")
    kept = blocks.where("page is not null and text is not null and block_id is not null")
    bad = _bad(_optional(blocks, "confidence", "double"), _optional(blocks, "risk_flags_json", "string"))
    scanned = kept.select(owner, "page", F.coalesce("ordinal", F.lit(0)).alias("ordinal"), "block_id", "kind", at(1).alias("y"), bad.alias("bad"), "text")
    # Documents on larger pages, and the lines that several pages of a document have, digits aside: few, and combined before the shuffle.
    large = kept.where(F.col("bbox_json").rlike(r"(?:84[2-9]|8[5-9]\d|9\d\d|\d{4,})(?:\.\d+)?\s*\]")).where(at(3) > PAGE_HEIGHT).groupBy(owner).agg((F.max(at(3)) / PAGE_HEIGHT).alias("scale"))
    short = kept.where((F.length("text") <= REPEATED_CHARS) & ~F.contains("text", F.lit("\n")) & ~F.col("kind").isin("heading", "table_row"))
    repeated = short.groupBy(owner, _mask(F.col("text")).alias("mask")).agg(F.count_distinct("page").alias("pages")).where((F.col("pages") >= REPEATED_PAGES) & (F.length("mask") > 2))
    page = ["document_id", "page"]
    once = scanned.repartition(*[F.col(c) for c in page]).dropDuplicates([*page, "block_id"])
    lines = F.transform(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    whole = Window.partitionBy(*page)
    down = whole.orderBy("ordinal", "block_id")
    seen = once.withColumn("lines", F.filter(lines, lambda x: x != "")).where(F.size("lines") > 0)
    # Han characters are twice as wide as letters; gaps between the parts of a line don't count.
    wide = F.array_max(F.transform("lines", lambda x: F.length(F.regexp_replace(_solid(x), r"[\x{2e80}-\x{ffef}]", "xx")) - F.length(F.regexp_extract(x, r"(\s{2,})", 1))))
    seen = seen.withColumn("wide", wide).withColumn("widest", F.max("wide").over(whole)).withColumn("from_top", F.row_number().over(down))
    seen = seen.withColumn("from_bottom", F.count("*").over(whole) - F.col("from_top") + 1)
    number = (F.size("lines") == 1) & _solid(F.get("lines", F.lit(0))).rlike(_NUMBER) & ~F.col("kind").eqNullSafe("table_row")
    bare = F.get("lines", F.lit(0)).rlike(r"^\s*\w*\d\w*\s*$")
    seen = seen.withColumn("number", number).withColumn("in_column", bare & F.coalesce(F.lag("number").over(down), F.lit(False)))

    last = F.element_at("lines", -1)
    seen = seen.join(small(cut(large)), "document_id", "left").withColumn("y", F.col("y") / F.coalesce("scale", F.lit(1.0)))
    seen = seen.withColumn("mask", F.when(F.size("lines") == 1, _mask(F.get("lines", F.lit(0))))).join(small(cut(repeated.withColumn("again", F.lit(True)).drop("pages"))), ["document_id", "mask"], "left")
    margin = F.when(F.col("y") < TOP_MARGIN, "top").when(F.col("y") >= BOTTOM_MARGIN, "bottom").when(F.col("y").isNotNull(), "body")
    edge = F.when(F.col("from_top") == 1, "top").when(F.col("from_bottom") <= 2, "bottom")
    open_short = (F.size("lines") == 1) & (F.col("wide") < SHORT_LINE * F.col("widest")) & ~last.rlike(r"[。；，、：.,;:!?！？]\s*$|^第.{1,4}条|^Article ")
    open_short = open_short | (F.size("lines") == 1) & last.rlike(r"^\d+\s{2,}\S|\S\s{2,}\d+$")
    in_text = F.col("kind").isin("heading", "table_row")
    furniture = (
        F.when(in_text, None)
        .when(F.col("number") & (F.col("from_bottom") == 1) & ((margin == "bottom") | (margin.isNull() & ~F.col("in_column"))), "page_number")
        .when(F.col("number") & (margin == "top"), "page_number")
        .when(F.col("number"), None)
        .when((margin == "top") & (F.col("from_top") <= 2) | (margin == "bottom") & (F.col("from_bottom") <= 2), "running_line")
        .when(margin.isNull() & edge.isNotNull() & (open_short | F.col("again")) & ~last.rlike(_CUT), "running_line")
    )
    marked = seen.withColumn("furniture", furniture)
    rows = marked.select(*page, "ordinal", "block_id", "kind", "furniture", "bad", F.posexplode(F.when(F.col("furniture").isNull(), F.col("lines")).otherwise(F.array(F.array_join("lines", " ")))).alias("line_no", "line"))
    text_down = Window.partitionBy(*page, F.col("furniture").isNull()).orderBy("ordinal", "block_id", "line_no")
    rows = cut(
        rows.withColumn("next_line", F.when(F.col("furniture").isNull(), F.lead("line").over(text_down))).withColumn("next_block", F.when(F.col("furniture").isNull(), F.lead("block_id").over(text_down)))
    )
    # The last line of text of a page goes on in the first of the next page that has text, wherever that is.
    text_lines = rows.where("furniture is null")
    first = text_lines.groupBy(*page).agg(F.min(F.struct("ordinal", "block_id", "line_no", "line")).alias("first"))
    after = next_by_number(first, "document_id", "page", "first", "then").select(*page, "then")
    over = text_lines.where("next_line is null").join(after, page, "left").select(
        *page, "ordinal", "block_id", "kind", "furniture", "bad", "line_no", "line", F.col("then.line").alias("next_line"), F.col("then.block_id").alias("next_block")
    )
    return rows.where("furniture is not null or next_line is not null").unionByName(cut(over))


def _mask(text: Column) -> Column:
    """A line without its digits and outer white space."""
    return F.trim(F.regexp_replace(text, r"\d+|^\s+|\s+$", ""))


def weighted(blocks: DataFrame) -> DataFrame:
    """(text, weight) of all blocks: one over the times that a block was delivered, so that it counts once; blocks without id count one each."""
    again = cut(blocks.where("block_id is not null").groupBy("block_id").agg(F.count("*").alias("times")).where("times > 1"))
    texts = blocks.where("text is not null").select("block_id", "text")
    return texts.join(small(again), "block_id", "left").select("text", (F.lit(1.0) / F.coalesce("times", F.lit(1))).alias("weight"))


def _tokens(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(_TOKEN), F.lit(0))


def broken_words(lines: DataFrame) -> DataFrame:
    """Candidates: block_id, line_no, head, tail, mark, next_block of words cut at a line end."""
    at_end = lines.where("furniture is null").where(F.col("line").rlike(_CUT)).where(F.col("next_line").rlike(r"^[\p{Ll}0-9!\x{fffd}]"))
    return at_end.select(
        "block_id", "line_no", F.regexp_extract("line", rf"({_TOKEN})[{_MARKS}]\s*$", 1).alias("head"), F.regexp_extract("line", rf"([{_MARKS}])\s*$", 1).alias("mark"),
        F.regexp_extract(_solid(F.col("next_line")), rf"^({_TOKEN})", 1).alias("tail"), "next_block",
    ).where("head <> '' and tail <> ''")


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word, n): words of Latin script of all texts (text, weight), in lower case."""
    return texts.select(F.explode(_tokens(F.lower("text"))).alias("word"), "weight").groupBy("word").agg(F.round(F.sum("weight")).cast("long").alias("n")).where("n > 0")


def hyphen_evidence(candidates: DataFrame, texts: DataFrame, words: DataFrame) -> DataFrame:
    """``candidates`` with ``spelled``: the mark belongs to the word, which stands hyphenated elsewhere more often than joined."""
    inside = F.regexp_extract_all(F.lower("text"), F.lit(rf"(?<!{_LETTER}){_LETTER}{{2,}}+[-‐]{_LETTER}{{2,}}+"), F.lit(0))
    hyphenated = texts.select(F.explode(inside).alias("w"), "weight").groupBy(F.translate("w", "‐", "-").alias("w")).agg(F.round(F.sum("weight")).cast("long").alias("hyphenated"))
    hyphenated = cut(hyphenated)
    asked = candidates.withColumn("w", F.lower(F.concat("head", F.lit("-"), "tail"))).withColumn("j", F.lower(F.concat("head", "tail")))
    wanted = asked.select("j").distinct()
    joined = words.select(F.col("word").alias("j"), F.col("n").alias("joined")).join(wanted, "j", "left_semi")
    both = asked.join(small(hyphenated), "w", "left").join(small(joined), "j", "left").fillna(0, ["hyphenated", "joined"])
    return both.withColumn("spelled", F.col("mark").isin("-", "‐") & (F.col("hyphenated") > F.col("joined"))).drop("w", "j", "hyphenated", "joined")


def anagram_hash(word: Column) -> Column:
    """Sum of the characters' hashes: the same for all orders of the characters."""
    return F.aggregate(F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0)), F.lit(0).cast("long"), lambda acc, c: acc + F.hash(c).cast("long"))


def _points(word: Column) -> Column:
    return F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0))


def learned_confusions(words: DataFrame, places: bool) -> DataFrame:
    """(right, wrong): single characters that are taken for each other, from words and their counts (word, n).

    A word's anagram hash less one character's, with that character's place and the word's length, is the same for all
    words that differ in this place only; of these the most frequent is what a rare one may stand for. A pair is learned
    if many rare words show it. For windows of Han script (``places``) that is at least LEAST_WINDOWS windows at each of
    the three places, as a window's neighbour may be a word of its own but not all three; for words LEAST_WORDS, and
    DOMINANCE times as many as for any other reading of the wrong character. Each wrong character has its best readings.
    """
    # Words of one or two letters differ in one place from too much.
    spread = words.where(F.length("word") >= (3 if places else 4)).select("n", anagram_hash(F.col("word")).alias("ah"), F.length("word").alias("len"), F.posexplode(_points(F.col("word"))).alias("at", "ch"))
    if places:
        spread = spread.where(F.col("ch").rlike(r"^[\x{3400}-\x{9fff}]$"))
    spread = spread.select("n", "ch", "at", "len", (F.col("ah") - F.hash("ch").cast("long")).alias("rest"))
    same = ["rest", "at", "len"]
    best = spread.where(F.col("n") >= LEAST_VARIANT).groupBy(*same).agg(F.max(F.struct("n", "ch")).alias("best"))
    shown = spread.join(best, same).where((F.col("ch") != F.col("best.ch")) & (F.col("best.n") >= VARIANT_RATIO * F.col("n"))).where(F.col("best.ch").rlike(r"^\p{L}$"))
    counts = shown.groupBy(F.col("best.ch").alias("right"), F.col("ch").alias("wrong"), "at").agg(F.count("*").alias("k"))
    if places:
        per = counts.groupBy("right", "wrong").agg(F.count_if(F.col("k") >= LEAST_WINDOWS).alias("full"), F.min("k").alias("k")).where("full = 3")
    else:
        per = counts.groupBy("right", "wrong").agg(F.sum("k").alias("k"))
    # One row per pair of characters from here on.
    ranked = per.withColumn("place", F.rank().over(Window.partitionBy("wrong").orderBy(F.desc("k")))).withColumn("next", F.lead("k").over(Window.partitionBy("wrong").orderBy(F.desc("k"), "right")))
    if not places:
        ranked = ranked.where((F.col("k") >= LEAST_WORDS) & (F.col("k") >= DOMINANCE * F.coalesce("next", F.lit(0))))
    return ranked.where("place = 1").select("right", "wrong")


def confusions(words: DataFrame, known: list[tuple[str, str]], places: bool) -> DataFrame:
    """(right, wrong): the learned and the known pairs, as a table; as many as there are confusable characters."""
    fixed = words.sparkSession.createDataFrame(known, "right string, wrong string")
    return cut(learned_confusions(words, places).unionByName(fixed).distinct())


def corrections(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, right, wrong, at, variant, sure, rank): rare words and the frequent words they are read for.

    ``words`` has word and n, ``pairs`` right and wrong. ``at`` is the 1-based place of the wrong characters. A variant
    must come WEAK_RATIO times as often as the word and WEAK_VARIANT times; it is ``sure`` at VARIANT_RATIO and
    LEAST_VARIANT. Rank 1 is the most frequent.
    """
    shifts = pairs.select("right", "wrong", (anagram_hash(F.col("right")) - anagram_hash(F.col("wrong"))).alias("shift"))
    hashed = words.withColumn("ah", anagram_hash(F.col("word")))
    points = _points(F.col("word"))
    # The characters and pairs of characters of a word meet the confusable ones.
    parts = F.array_distinct(F.concat(points, F.transform(F.sequence(F.lit(1), F.greatest(F.length("word") - 1, F.lit(1))), lambda i: F.substring("word", i, F.lit(2)))))
    rare = hashed.select("word", "n", "ah", F.explode(parts).alias("wrong")).join(small(shifts), "wrong").select("word", "n", "right", "wrong", (F.col("ah") + F.col("shift")).alias("ah"))
    variants = hashed.where((F.col("n") >= WEAK_VARIANT) & (F.length("word") >= 3)).select(F.col("word").alias("variant"), F.col("n").alias("times"), "ah")
    near = rare.join(variants, "ah").where(F.col("times") >= WEAK_RATIO * F.col("n"))
    places = F.filter(
        F.sequence(F.lit(1), F.length("word")),
        lambda i: (F.substring("word", i, F.length("wrong")) == F.col("wrong"))
        & (F.concat(F.substring("word", F.lit(1), i - 1), "right", F.substring("word", i + F.length("wrong"), F.length("word"))) == F.col("variant")),
    )
    sure = (F.col("times") >= VARIANT_RATIO * F.col("n")) & (F.col("times") >= LEAST_VARIANT)
    found = near.withColumn("at", F.get(places, F.lit(0))).where("at is not null").withColumn("sure", sure)
    rank = F.row_number().over(Window.partitionBy("word", "at", "wrong").orderBy(F.desc("times"), "variant"))
    return found.withColumn("rank", rank).select("word", "right", "wrong", "at", "variant", "sure", "rank")


def _plain(line: Column) -> Column:
    """A line for windows of Han script: put together, all digits as one sign."""
    return F.regexp_replace(_solid(line), r"\d", "#")


def misread_latin(lines: DataFrame, candidates: DataFrame, words: DataFrame) -> DataFrame:
    """(block_id, word, variant, sure): misread words of Latin script; variant is null where only the spelling shows it."""
    line = F.regexp_replace(_solid(F.col("line")), rf"({_TOKEN})[{_MARKS}]\s*$", "")
    single = lines.where("furniture is null").select("block_id", F.explode(_tokens(line)).alias("token"))
    # A token is taken once per block; a cut word stands with both its parts, not as the tail in its next line.
    single = single.select("block_id", F.lit(None).cast("string").alias("next_block"), F.lower("token").alias("word"), F.length("token").alias("head"))
    tails = candidates.select(F.col("next_block").alias("block_id"), F.lower("tail").alias("word"))
    single = single.join(small(tails), ["block_id", "word"], "left_anti").select("block_id", "next_block", "word", "head")
    cut_words = candidates.select("block_id", F.when(F.col("next_block") != F.col("block_id"), F.col("next_block")).alias("next_block"), F.lower(F.concat("head", "tail")).alias("word"), F.length("head").alias("head"))
    used = single.where(F.length("word") >= 3).unionByName(cut_words).distinct()
    asked = used.select("word").distinct()
    extra = asked.join(words, "word", "left_anti").withColumn("n", F.lit(1).cast("long"))
    fixes = corrections(words.unionByName(extra), confusions(words, LATIN_CONFUSIONS, places=False)).where("rank = 1")
    lexicon = fixes.groupBy("word").agg(F.min(F.struct((~F.col("sure")).alias("weak"), "at", "variant")).alias("fix"))
    known = used.join(lexicon, "word").select(
        F.when(F.col("fix.at") <= F.col("head"), F.col("block_id")).otherwise(F.coalesce("next_block", "block_id")).alias("block_id"), "word", F.col("fix.variant").alias("variant"), (~F.col("fix.weak")).alias("sure")
    )
    letters = F.length(F.regexp_replace("word", r"[^\p{L}]", ""))
    odd_number = F.col("word").rlike(r"^[0-9lozibsgq]+$") & F.col("word").rlike(r"\d") & F.col("word").rlike(r"\p{L}")
    odd_word = (letters >= 3) & F.col("word").rlike(r"[015689]|!\p{L}") & ~F.col("word").rlike(r"^\d+\p{L}+$|^\p{L}+\d{2,}$")
    odd = lines.where("furniture is null").select("block_id", F.explode(_tokens(F.lower(_solid(F.col("line"))))).alias("word")).where(odd_number | odd_word | F.col("word").contains("�"))
    lost = lines.where("furniture is null").where(F.col("line").contains("�")).select("block_id", F.lit("�").alias("word"))
    return known.unionByName(odd.unionByName(lost).withColumn("variant", F.lit(None).cast("string")).withColumn("sure", F.lit(True)))


def _count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        weight = batch.column(1).to_numpy()
        for s in slices(pa.array(np.zeros(batch.num_rows, dtype=np.int64)), batch.column(0)):
            if len(s.cp) < 3:
                continue
            cp = np.where((s.cp >= 0x30) & (s.cp <= 0x39), ord("#"), s.cp).astype(np.int64)
            inside, line_end, owner = (cp >= 0x3400) & (cp <= 0x9FFF), cp == 0xA, s.owner()
            keep = (inside[:-2] | inside[1:-1] | inside[2:]) & ~(line_end[:-2] | line_end[1:-1] | line_end[2:]) & (owner[:-2] == owner[2:])
            coded, which = np.unique(((cp[:-2] << 42) | (cp[1:-1] << 21) | cp[2:])[keep], return_inverse=True)
            # Of no windows bincount makes whole numbers, whatever the weights: the type is given below.
            n = np.bincount(which, weights=weight[s.rows][owner[:-2][keep]], minlength=len(coded))
            spelled = np.stack([coded >> 42, (coded >> 21) & 0x1FFFFF, coded & 0x1FFFFF], axis=1).astype(np.uint32).tobytes().decode("utf-32-le", "replace")
            yield pa.RecordBatch.from_arrays([pa.array([spelled[i : i + 3] for i in range(0, len(spelled), 3)], pa.string()), pa.array(n, pa.float64())], names=["word", "n"])


def han_windows(texts: DataFrame) -> DataFrame:
    """(word, n): windows of three characters of a line with Han script, digits as one sign, of all texts (text, weight)."""
    return in_arrow(texts.select("text", "weight"), _count_windows, "word string, n double").groupBy("word").agg(F.round(F.sum("n")).cast("long").alias("n")).where("n > 0")


def misread_han(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """(block_id, line_no, at, right): misread characters of Han script; ``at`` is the 1-based place in the plain line.

    Of the up to three windows around a character, those that have the same frequent variant must be all, or two if the
    other is too rare to say anything; a window that is frequent as it stands speaks for the character read.
    """
    grams = cut(han_windows(texts))
    pairs = confusions(grams, [(p[0], p[1]) for p in HAN_CONFUSIONS], places=True)
    wrongs = [r["wrong"] for r in pairs.select("wrong").distinct().collect()]  # at most one per character of the script
    asked = grams.where(F.col("word").rlike("[" + "".join(wrongs) + "]")) if wrongs else grams.where("false")
    lexicon = corrections(grams, pairs).where("sure").select("word", "right", "wrong", "at")
    frequent = asked.where(F.col("n") >= LEAST_VARIANT).select("word", F.lit(True).alias("frequent"))

    plain = lines.where("furniture is null").select("block_id", "line_no", _plain(F.col("line")).alias("line")).where(F.length("line") > 0)
    is_wrong = lambda i: F.substring("line", i, F.lit(1)).isin(*wrongs)
    place = plain.select("block_id", "line_no", "line", F.explode(F.filter(F.sequence(F.lit(1), F.length("line")), is_wrong)).alias("at"))
    starts = F.filter(F.transform(F.array(F.lit(2), F.lit(1), F.lit(0)), lambda k: F.col("at") - k), lambda s: (s >= 1) & (s + 2 <= F.length("line")))
    seen = place.withColumn("windows", F.size(starts)).select("block_id", "line_no", "at", "windows", F.explode(starts).alias("start"), "line").select(
        "block_id", "line_no", F.col("at").alias("place"), "windows", F.substring("line", F.col("start"), F.lit(3)).alias("word"), (F.col("at") - F.col("start") + 1).alias("at")
    )
    agreed = cut(seen.join(lexicon, ["word", "at"]).groupBy("block_id", "line_no", "place", "right").agg(F.count("*").alias("n"), F.max("windows").alias("windows")))
    all_, most = agreed.where("n = windows"), agreed.where("n = 2 and windows = 3")
    # What the third window says is asked for the few places where it does not agree; only their lines are looked at again.
    again = plain.join(small(most.select("block_id", "line_no", "place").distinct()), ["block_id", "line_no"])
    three = again.select("block_id", "line_no", "place", "line", F.explode(F.array(F.lit(2), F.lit(1), F.lit(0))).alias("k")).select("block_id", "line_no", "place", F.substring("line", F.col("place") - F.col("k"), F.lit(3)).alias("word"), (F.col("k") + 1).alias("at"))
    third = three.join(lexicon, ["word", "at"], "left_anti").join(frequent, "word", "left_semi").select("block_id", "line_no", "place")
    silent = most.join(third.distinct(), ["block_id", "line_no", "place"], "left_anti")
    return all_.unionByName(silent).select("block_id", "line_no", F.col("place").alias("at"), "right")


def noise(blocks: DataFrame) -> DataFrame:
    """(block_id, noise): each kind of noise of each scanned block.

    ``blocks`` has block_id, document_id, ordinal, kind, page, bbox_json, text, and may have confidence and
    risk_flags_json; other columns are ignored. Blocks without page, text or block_id have none, an empty table gives an
    empty result. Repeated blocks give one row per kind.
    """
    lines = page_lines(blocks)
    furniture = lines.where("furniture is not null").select("block_id", F.col("furniture").alias("noise"))
    texts = weighted(blocks)
    words = cut(vocabulary(texts))
    candidates = cut(hyphen_evidence(broken_words(lines), texts, words))
    kind = lambda df, name: df.select("block_id", F.lit(name).alias("noise"))
    latin = cut(misread_latin(lines, candidates, words))
    sure = cut(
        furniture.unionByName(kind(candidates.where("not spelled"), "broken_word"))
        .unionByName(kind(lines.where("furniture is null").where(F.col("line").rlike(_SPACED)), "spaced_out"))
        .unionByName(kind(latin.where("sure"), "misread"))
        .unionByName(kind(misread_han(lines, texts), "misread"))
        .distinct()
    )
    # Badly recognised blocks that show nothing yet are believed at weaker evidence.
    left = lines.where("bad").select("block_id").distinct().join(sure.select("block_id"), "block_id", "left_anti")
    return sure.unionByName(kind(latin.where("not sure").join(left, "block_id", "left_semi"), "misread").distinct())


def paragraphs(blocks: DataFrame) -> DataFrame:
    """(document_id, page, paragraph, part, text): the continuous paragraphs of scanned documents, repaired.

    Edge lines are gone, cut words joined, letters set apart put together, misread characters corrected where a frequent
    variant is known. A paragraph begins with a heading, table row or article label, belongs to the page where it begins,
    and goes on over page ends. ``paragraph`` counts from 1 on its page; text before the first beginning is 0. What goes
    on over more than PARAGRAPH_PAGES pages comes in parts, so no row is larger than that many pages.
    """
    lines = page_lines(blocks)
    texts = weighted(blocks)
    words = cut(vocabulary(texts))
    candidates = cut(hyphen_evidence(broken_words(lines), texts, words))
    latin = misread_latin(lines, candidates, words).where("variant is not null and sure").groupBy("block_id").agg(F.collect_set(F.struct("word", "variant")).alias("words"))
    han = misread_han(lines, texts).groupBy("block_id", "line_no").agg(F.collect_set(F.struct("at", "right")).alias("chars"))
    joined = candidates.groupBy("block_id", "line_no").agg(F.max("spelled").alias("spelled"))
    text = lines.where("furniture is null").join(latin, "block_id", "left").join(han, ["block_id", "line_no"], "left").join(joined, ["block_id", "line_no"], "left")

    word = lambda w: F.concat(F.lit(r"(?<![A-Za-z0-9])"), w, F.lit(r"(?![A-Za-z0-9])"))
    right = F.aggregate(F.coalesce("chars", F.array().cast("array<struct<at:int,right:string>>")), _solid(F.col("line")), lambda acc, x: F.overlay(acc, x["right"], x["at"], F.lit(1)))
    fixed = F.aggregate(
        F.coalesce("words", F.array().cast("array<struct<word:string,variant:string>>")), right,
        lambda acc, x: F.regexp_replace(F.regexp_replace(acc, word(x["word"]), x["variant"]), word(F.initcap(x["word"])), F.initcap(x["variant"])),
    )
    ends_wide = F.col("line").rlike(r"[\x{2e80}-\x{ffef}]$")
    piece = F.when(F.col("spelled").isNull(), F.concat(fixed, F.when(ends_wide, "").otherwise(" "))).when(F.col("spelled"), fixed).otherwise(F.regexp_replace(fixed, rf"[{_MARKS}]\s*$", ""))
    begins = F.col("kind").isin("heading", "table_row") & (F.col("line_no") == 0) | F.col("line").rlike(r"^第.{1,6}条|^Article \w+")
    down = Window.partitionBy("document_id", "page").orderBy("ordinal", "block_id", "line_no")
    placed = cut(text.select("document_id", "page", "ordinal", "block_id", "line_no", piece.alias("piece"), F.sum(begins.cast("int")).over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("paragraph")))

    # What stands before a page's first beginning goes on from the last page before on which a paragraph begins.
    ends = placed.groupBy("document_id", "page").agg(F.max("paragraph").alias("last"))
    homes = greatest_before(ends, "document_id", "page", F.when(F.col("last") > 0, F.struct("page", "last")), "home").select("document_id", "page", "home")
    all_ = placed.join(homes, ["document_id", "page"], "left").withColumn("early", F.col("paragraph") == 0)
    owned = all_.select(
        "document_id", F.when(F.col("early"), F.coalesce("home.page", "page")).otherwise(F.col("page")).alias("of_page"),
        F.when(F.col("early"), F.coalesce("home.last", F.lit(0))).otherwise(F.col("paragraph")).cast("int").alias("paragraph"),
        F.struct("page", "ordinal", "block_id", "line_no", "piece").alias("x"),
    )
    part = F.floor((F.col("x.page") - F.col("of_page")) / PARAGRAPH_PAGES).cast("int").alias("part")
    whole = owned.groupBy("document_id", F.col("of_page").alias("page"), "paragraph", part).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return whole.select("document_id", "page", "paragraph", "part", F.trim(F.array_join("x.piece", "")).alias("text"))


def _blocks(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "document_blocks")


def found(spark: SparkSession, base: str) -> DataFrame:
    """p5_found: kinds of noise by block of a scanned page."""
    return noise(_blocks(spark, base))


def repaired(spark: SparkSession, base: str) -> DataFrame:
    """p5_paragraphs: the repaired paragraphs of all scanned documents."""
    return paragraphs(_blocks(spark, base))
