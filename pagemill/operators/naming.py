"""Names of detected columns, by the words of their markup."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of class names and the names they give.
WORDS = dict(x.split("=") for x in """
title=제목 name=이름 heading=제목 subject=제목 author=작성자 writer=작성자 artist=작성자 seller=판매자 brand=브랜드 price=가격 cost=가격 amount=금액
discount=할인 date=날짜 time=시간 datetime=날짜 published=날짜 created=날짜 updated=날짜 desc=설명 description=설명 summary=요약 excerpt=요약
content=내용 body=내용 text=내용 quote=인용 tag=태그 tags=태그 category=분류 categories=분류 genre=장르 rating=평점 score=점수 star=별점 stars=별점
review=후기 reviews=후기 comment=댓글 comments=댓글 count=개수 views=조회수 view=조회수 likes=좋아요 status=상태 stock=재고 address=주소 location=위치
phone=전화 tel=전화 email=이메일 duration=길이 size=크기 color=색상 image=이미지 img=이미지 photo=사진 thumb=썸네일 thumbnail=썸네일 link=링크 url=링크
href=링크
""".split())  # fmt: skip
# What an element is called, and what a kind of value is.
TAGS = dict(x.split("=") for x in "h1=제목 h2=제목 h3=제목 h4=제목 h5=제목 h6=제목 img=이미지 time=날짜 a=링크 p=내용 li=항목 td=값 th=항목 button=버튼 label=이름표".split())
KINDS = {"href": "링크", "src": "이미지"}
FALLBACK = "항목"


def _called(words: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(words)), "map<string,string>")


def words(text: Column) -> Column:
    """The lower-case words of an identifier in any of its spellings."""
    spaced = F.regexp_replace(text, "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.filter(F.split(F.lower(spaced), r"[-_.\s]+"), lambda w: w != "")


def _first(values: Column) -> Column:
    return F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(1))


def name(selector: Column, kind: Column) -> Column:
    """One column's name: of the last step of its selector, the last class that says anything, by its first known word or
    else as written; then the attribute, the element, the kind of value."""
    leaf = F.trim(F.substring_index(F.coalesce(selector, F.lit("")), ">", -1))
    known, dotted = _called(WORDS), F.split(leaf, r"\.")
    classes = F.reverse(F.slice(dotted, F.lit(2), F.size(dotted)))
    told = F.transform(classes, lambda c: F.coalesce(_first(F.transform(words(c), lambda w: F.try_element_at(known, w))), F.nullif(F.array_join(words(c), " "), F.lit(""))))
    attribute = F.when(kind.startswith("attr:"), _first(F.transform(F.reverse(words(F.substring(kind, 6, 1 << 30))), lambda w: F.try_element_at(known, w))))
    return F.coalesce(_first(told), attribute, F.try_element_at(_called(TAGS), F.element_at(dotted, 1)), F.try_element_at(_called(KINDS), kind), F.lit(FALLBACK))


def names(columns: Column, selector: str = "path") -> Column:
    """Names of an array of columns (``selector``, kind), all different: where a name repeats the kind of value joins it,
    and where that repeats a number does. An empty array has none; null stays null."""
    plain = F.transform(columns, lambda c: F.struct(name(c[selector], c["kind"]).alias("base"), F.try_element_at(_called(KINDS), c["kind"]).alias("suffix")))
    again = lambda c: F.size(F.filter(plain, lambda x: x["base"] == c["base"])) > 1
    wanted = F.transform(plain, lambda c: F.when(again(c) & (c["suffix"] != c["base"]), F.concat(c["base"], F.lit(" "), c["suffix"])).otherwise(c["base"]))

    def step(used: Column, want: Column) -> Column:
        forms = F.transform(F.sequence(F.lit(1), F.size(used) + 1), lambda n: F.when(n == 1, want).otherwise(F.concat(want, n.cast("string"))))
        return F.concat(used, F.array(F.element_at(F.filter(forms, lambda f: ~F.array_contains(used, f)), 1)))

    return F.aggregate(wanted, F.array().cast("array<string>"), step)


def picked(columns: Column, names_of: Column) -> Column:
    """Columns with their names, the shape that a recipe takes: (name, path, kind)."""
    return F.zip_with(columns, names_of, lambda c, n: F.struct(n.alias("name"), c["path"].alias("path"), c["kind"].alias("kind")))
