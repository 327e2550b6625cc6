"""Rule tables stated in the analysis prompt, applied to whole tables
(L3-L7, A14, J7, J8; T13, T21, T22).

Keyword rules compile to one projected expression per row: every rule
contributes ``(level, -len(keyword), rule_index, label)`` when its keyword
occurs, and ``array_min`` picks the winner -- lowest level, then the longest
keyword (so '무신호' beats the '신호' it contains), then table order. No join
and no row blow-up; the rule table is a bounded, driver-side literal. Rules that
come from tables, in any number, are in ``rule_tables``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.js import clamp


@dataclass(frozen=True)
class KeywordRule:
    label: str
    level: int
    keywords: tuple[str, ...]


# Party-type keywords (step 1-A), in table order.
CATEGORY_RULES = [
    KeywordRule("차대자전거", 1, ("자전거", "자전거도로", "바이크", "이륜")),
    KeywordRule("차대사람", 2, ("보행자", "횡단보도", "보행", "무단횡단", "어린이", "보행중")),
]
CATEGORY_DEFAULT = "차대차"

# Car-to-car sub-types (step 1-B), keywords in table order
# ('넓은도로/좁은도로' is two keywords).
CAR_SUBTYPE_KEYWORDS = [
    ("교차로신호", ("교차로", "녹색", "적색", "황색", "신호", "좌회전", "우회전", "비보호")),
    ("교차로무신호", ("무신호", "같은폭", "넓은도로", "좁은도로", "일시정지")),
    ("대향", ("중앙선", "대향", "역주행", "정면충돌")),
    ("동행", ("차선변경", "추월", "같은방향", "앞차", "뒤차", "추돌", "급정거")),
    ("합류", ("합류", "진입로", "톨게이트", "가속차로")),
    ("고속도로", ("고속도로", "본선", "갓길", "졸음")),
    ("기타", ("주차장", "주차", "후진", "출차", "개문", "유턴", "도로외", "골목")),
]
# Keywords the prohibition rules rank first -- parking, reversing,
# exit, door opening and U-turn (rules 4 and 6) -- then the signal words (rule 5).
PRIORITY_KEYWORDS = [
    ("주차장", "후진", "출차", "개문", "유턴"),
    ("녹색", "적색", "황색", "신호"),
]


def _leveled(table: list[tuple[str, tuple[str, ...]]], priority: list[tuple[str, ...]]) -> list[KeywordRule]:
    """Rules with levels: a keyword named in ``priority[i]`` gets level i+1 and
    every other keyword the level after them. A keyword containing a
    priority keyword (e.g. '무신호' containing '신호') is raised to that level
    too, so the longer, more specific keyword still wins within the level."""
    rest = len(priority) + 1

    def level(kw: str) -> int:
        for i, group in enumerate(priority):
            if any(p in kw for p in group):
                return i + 1
        return rest

    rules = []
    for label, kws in table:
        by_level: dict[int, list[str]] = {}
        for kw in kws:
            by_level.setdefault(level(kw), []).append(kw)
        rules += [KeywordRule(label, lv, tuple(k)) for lv, k in sorted(by_level.items())]
    return rules


CAR_SUBCATEGORY_RULES = _leveled(CAR_SUBTYPE_KEYWORDS, PRIORITY_KEYWORDS)
# Bicycle (step 1-C) and pedestrian (step 1-D) sub-types.
BICYCLE_SUBCATEGORY_RULES = [
    KeywordRule("교차로자전거", 1, ("교차로", "우회전", "좌회전")),
    KeywordRule("동행자전거", 2, ("같은방향", "추월")),
]
PEDESTRIAN_SUBCATEGORY_RULES = [
    KeywordRule("횡단보도", 1, ("횡단보도",)),
]
SUBCATEGORY_RULES = {
    "차대차": (CAR_SUBCATEGORY_RULES, None),
    "차대자전거": (BICYCLE_SUBCATEGORY_RULES, "기타자전거"),
    "차대사람": (PEDESTRIAN_SUBCATEGORY_RULES, "기타보행"),
}

# Permitted diagram id ranges per sub-type: (prefix, lo, hi).
ID_RANGES = {
    "교차로신호": ("", 101, 126),
    "교차로무신호": ("", 201, 223),
    "대향": ("", 301, 317),
    "동행": ("", 401, 428),
    "합류": ("", 501, 510),
    "고속도로": ("", 551, 561),
    "기타": ("", 601, 626),
    "교차로자전거": ("거", 1, 7),
    "동행자전거": ("거", 2, 21),
    "기타자전거": ("거", 4, 26),
    "횡단보도": ("보", 1, 10),
    "기타보행": ("보", 11, 33),
}
CATEGORY_PREFIX = {"차대차": "", "차대자전거": "거", "차대사람": "보"}


def _contains(text: Column, kw: str, ignore_case: bool) -> Column:
    if ignore_case:
        return F.contains(F.lower(text), F.lit(kw.lower()))
    return F.contains(text, F.lit(kw))


def keyword_winner(text, rules: list[KeywordRule], ignore_case: bool = False) -> Column:
    """Struct (level, neg_len, idx, label, keyword) of the winning rule, or null."""
    t = F.col(text) if isinstance(text, str) else text
    cands, idx = [], 0
    for r in rules:
        for kw in r.keywords:
            hit = F.struct(F.lit(r.level).alias("level"), F.lit(-len(kw)).alias("neg_len"),
                           F.lit(idx).alias("idx"), F.lit(r.label).alias("label"),
                           F.lit(kw).alias("keyword"))
            cands.append(F.when(_contains(t, kw, ignore_case), hit))
            idx += 1
    return F.array_min(F.array_compact(F.array(*cands)))


def classify(df: DataFrame, text: str, rules: list[KeywordRule] | None = None,
             default: str | None = CATEGORY_DEFAULT, out: str = "category",
             matched: str | None = "matched_keyword", ignore_case: bool = False) -> DataFrame:
    """Label each row by the highest-priority keyword rule it contains."""
    win = keyword_winner(text, rules or CATEGORY_RULES, ignore_case)
    df = df.withColumn("_win", win).withColumn(out, F.coalesce(F.col("_win.label"), F.lit(default)))
    if matched:
        df = df.withColumn(matched, F.col("_win.keyword"))
    return df.drop("_win")


def subclassify(df: DataFrame, text: str, category: str,
                table: dict[str, tuple[list[KeywordRule], str | None]] | None = None,
                out: str = "subcategory", ignore_case: bool = False) -> DataFrame:
    """L4: sub-type from the rule table of the row's category."""
    table = table or SUBCATEGORY_RULES
    expr = F.lit(None).cast("string")
    for cat, (rules, default) in table.items():
        win = keyword_winner(text, rules, ignore_case)
        expr = F.when(F.col(category) == F.lit(cat),
                      F.coalesce(win["label"], F.lit(default).cast("string"))).otherwise(expr)
    return df.withColumn(out, expr)


def id_range_text(subcategory: str, ranges: dict | None = None) -> Column:
    """'101~126' / '거1~거7' for a sub-type column."""
    ranges = ranges or ID_RANGES
    expr = F.lit(None).cast("string")
    for sub, (prefix, lo, hi) in ranges.items():
        expr = F.when(F.col(subcategory) == F.lit(sub), F.lit(f"{prefix}{lo}~{prefix}{hi}")).otherwise(expr)
    return expr


def split_diagram_id(diagram_id) -> tuple[Column, Column]:
    """'보4' -> ('보', 4); '101' -> ('', 101). Non-matching ids give nulls."""
    d = F.col(diagram_id) if isinstance(diagram_id, str) else diagram_id
    m = r"^(\D*)(\d+)$"
    prefix = F.when(d.rlike(m), F.regexp_extract(d, m, 1))
    num = F.regexp_extract(d, m, 2).try_cast("int")
    return prefix, num


def range_check(category: Column, prefix: Column, number: Column,
                ranges: list[tuple[str, str, int, int]]) -> tuple[Column, Column]:
    """L5/J7 (T22): is (prefix, number) inside any permitted range of the category?

    ``ranges`` = [(category, prefix, lo, hi)], a bounded literal; overlapping
    ranges are fine since only containment is checked. Returns (ok, reason).
    """
    has_rule = F.lit(False)
    inside = F.lit(False)
    for cat, pre, lo, hi in ranges:
        same = category == F.lit(cat)
        has_rule = has_rule | same
        inside = inside | (same & (F.coalesce(prefix, F.lit("")) == F.lit(pre))
                           & number.between(F.lit(lo), F.lit(hi)))
    inside = F.coalesce(inside, F.lit(False))
    reason = (F.when(~has_rule, F.lit("no_rule"))
               .when(number.isNull(), F.lit("bad_id"))
               .when(~inside, F.lit("out_of_range")))
    return inside, reason


# The words of the prohibition rules 1, 2 and 4.
BICYCLE_WORDS = ("자전거",)
PEDESTRIAN_WORDS = ("보행자", "횡단보도")
LOT_WORDS = ("주차장", "후진", "출차", "개문")


def broken_rule(text: Column, diagram_id) -> Column:
    """The first prohibition rule that the chosen diagram breaks, or null.

    1. a bicycle in the text: only bicycle diagrams; 2. a pedestrian: only
    pedestrian diagrams; 3. neither: none of the two; 4. parking, reversing,
    leaving or a door, between cars: only 601 to 626.
    """
    prefix, number = split_diagram_id(diagram_id)
    says = lambda words: F.coalesce(text.rlike("|".join(words)), F.lit(False))
    bicycle, pedestrian = says(BICYCLE_WORDS), says(PEDESTRIAN_WORDS)
    is_ = lambda p: F.coalesce(prefix == F.lit(p), F.lit(False))
    lo, hi = ID_RANGES["기타"][1:]
    lot = F.coalesce(is_("") & number.between(lo, hi), F.lit(False))
    return (F.when(bicycle & ~is_(CATEGORY_PREFIX["차대자전거"]), 1)
             .when(pedestrian & ~bicycle & ~is_(CATEGORY_PREFIX["차대사람"]), 2)
             .when(~bicycle & ~pedestrian & (is_(CATEGORY_PREFIX["차대자전거"]) | is_(CATEGORY_PREFIX["차대사람"])), 3)
             .when(~bicycle & ~pedestrian & says(LOT_WORDS) & ~lot, 4))


def category_ranges() -> list[tuple[str, str, int, int]]:
    """Category-level ranges (the union of its sub-type ranges)."""
    out = []
    for cat, (rules, default) in SUBCATEGORY_RULES.items():
        subs = list(dict.fromkeys([r.label for r in rules] + ([default] if default else [])))
        for s in subs:
            pre, lo, hi = ID_RANGES[s]
            out.append((cat, pre, lo, hi))
    return out


# Title formats "X vs Y" and base ratio "A30:B70".
TITLE_ID = r"^\s*([^:]+?)\s*:"
TITLE_LABELS = r"^(?:[^:]*:\s*)?(.+?) vs (.+?)(?:\s*\(A\d+:B\d+\))?\s*$"
TITLE_BASE = r"A(\d+):B(\d+)"


def parse_title(title) -> dict[str, Column]:
    """Diagram id, A/B labels and base ratio from a diagram title."""
    t = F.col(title) if isinstance(title, str) else title
    nz = lambda c: F.nullif(c, F.lit(""))
    return {
        "diagram_id": nz(F.regexp_extract(t, TITLE_ID, 1)),
        "label_a": nz(F.regexp_extract(t, TITLE_LABELS, 1)),
        "label_b": nz(F.regexp_extract(t, TITLE_LABELS, 2)),
        "base_fault_a": nz(F.regexp_extract(t, TITLE_BASE, 1)).try_cast("int"),
        "base_fault_b": nz(F.regexp_extract(t, TITLE_BASE, 2)).try_cast("int"),
    }


def align_parties(user_a_label: Column, user_b_label: Column, label_a: Column, label_b: Column,
                  user_fault_a: Column | None = None, user_fault_b: Column | None = None) -> dict[str, Column]:
    """Map the user's parties onto the diagram's A/B definition.

    When the user's 'A' is the diagram's B (or the user's 'B' is the
    diagram's A) the parties are swapped; faults follow their party.
    """
    swapped = F.coalesce((user_a_label == label_b) | (user_b_label == label_a), F.lit(False))
    out = {
        "swapped": swapped,
        "user_a_side": F.when(swapped, F.lit("B")).otherwise(F.lit("A")),
        "user_b_side": F.when(swapped, F.lit("A")).otherwise(F.lit("B")),
    }
    if user_fault_a is not None and user_fault_b is not None:
        out["fault_a"] = F.when(swapped, user_fault_b).otherwise(user_fault_a)
        out["fault_b"] = F.when(swapped, user_fault_a).otherwise(user_fault_b)
    return out


def apply_modifier_array(base, mods, target: str, lo: int = 0, hi: int = 100) -> Column:
    """A14 (array form): base + sum of the modifiers aimed at ``target``, clamped.

    A null base stays null (T13: greatest/least would turn it into a bound).
    """
    b = F.col(base) if isinstance(base, str) else base
    m = F.coalesce(F.col(mods) if isinstance(mods, str) else mods,
                   F.array().cast("array<struct<name:string,target:string,value:int,reason:string>>"))
    picked = F.filter(m, lambda x: x["target"] == F.lit(target))
    total = F.aggregate(picked, F.lit(0).cast("bigint"),
                        lambda acc, x: acc + F.coalesce(x["value"].cast("bigint"), F.lit(0).cast("bigint")))
    return clamp(b + total, lo, hi)


def apply_modifier_rows(df: DataFrame, key: str, base_a, base_b, target: str, value: str,
                        lo: int = 0, hi: int = 100) -> DataFrame:
    """A14 (row form): one modifier per row; per-key sums per side, clamped.

    A grouped aggregate (partial before the shuffle) -- a key with a huge
    number of modifiers is combined map-side.
    """
    v = F.col(value).cast("bigint")
    g = df.groupBy(key).agg(
        F.sum(F.when(F.col(target) == F.lit("A"), v)).alias("_sa"),
        F.sum(F.when(F.col(target) == F.lit("B"), v)).alias("_sb"),
        F.count(F.lit(1)).alias("n_modifiers"))
    ba = base_a if isinstance(base_a, Column) else F.lit(base_a)
    bb = base_b if isinstance(base_b, Column) else F.lit(base_b)
    return g.select(key,
                    clamp(ba + F.coalesce("_sa", F.lit(0)), lo, hi).alias("fault_a"),
                    clamp(bb + F.coalesce("_sb", F.lit(0)), lo, hi).alias("fault_b"),
                    "n_modifiers")
