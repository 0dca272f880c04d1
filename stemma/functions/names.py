"""Column functions on names and texts. The four normal forms differ on purpose; never mix them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tight(name: Column) -> Column:
    """Without any white space, case kept."""
    return F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)\s+", "")


def duplicate_key(name: Column) -> Column:
    """Trimmed, lower case, without spaces, tabs and wide spaces."""
    return F.lower(F.translate(stripped(name), " \t\u3000", ""))


def graph_key(name: Column) -> Column:
    """Lower case, without spaces, tabs and wide spaces; other white space at the ends stays."""
    return F.lower(F.translate(F.coalesce(name, F.lit("")), " \t\u3000", ""))


def text_key(text: Column) -> Column:
    """Lower case without any white space."""
    return F.lower(tight(text))


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Levenshtein distance, or most + 1 where it is larger."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def stripped(text: Column) -> Column:
    """Without white space at the ends. Most texts have none there, which the two characters at the ends tell."""
    whole = F.coalesce(text, F.lit(""))
    ends = F.concat(F.substring(whole, 1, 1), F.substring(whole, -1, 1))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(whole, r"(?U)^\s+|\s+$", "")).otherwise(whole)


def plain_letters(text: Column) -> Column:
    return text.rlike(r"^[\x00-\x7F]*$")


# Words that carry no search.
STOP_WORDS = (
    "请问", "帮我", "搜索", "检索", "一下", "介绍", "如何", "怎样", "怎么样", "何处",
    "哪里", "谁", "什么", "怎么", "为什么", "吗", "呢", "的", "是", "了", "关于",
    "家谱", "族谱", "谱书", "内容", "全文", "故事", "简介", "历史", "在", "里",
    "有", "没有", "找", "查", "看", "第", "几", "代", "位", "中", "和", "与",
    "及", "为", "从", "到", "其", "该", "这", "那", "一", "不", "也", "就", "都",
)


def question_tokens(text: Column, stop: tuple[str, ...] = STOP_WORDS, most: int = 12) -> Column:
    """Search words: runs of two or more ideographs, letters or digits; runs with more than six ideographs give pairs of them.

    Stop words go; the first `most` distinct ones stay, in order. An odd last ideograph is left out.
    """
    runs = F.regexp_extract_all(text, F.lit("[\\u4e00-\\u9fffA-Za-z0-9]{2,}"), F.lit(0))
    runs = F.filter(runs, lambda r: ~F.lower(r).isin(*stop)) if stop else runs
    han = lambda r: F.regexp_replace(r, "[^\\u4e00-\\u9fff]", "")
    pairs = lambda h: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(h) - 1), F.lit(2)), lambda i: F.substring(h, i, F.lit(2)))
    parts = F.transform(runs, lambda r: F.when(F.length(F.regexp_replace(r, "[A-Za-z0-9]", "")) > 6, pairs(han(r))).otherwise(F.array(r)))
    return F.slice(F.array_distinct(F.flatten(parts)), 1, most)


def clean_file_name(path: Column) -> Column:
    """Last part of a path, what is no letter, digit, ideograph, dot, space or dash as an underscore, 200 characters at most."""
    return F.substring(F.regexp_replace(F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1), r"(?U)[^\w一-鿿.\- ]", "_"), 1, 200)
