"""Text functions as Column expressions: normalising, numerals, article keys, dates, identifiers."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .rules import ALIASES

#: Chinese digits and units.
DIGITS = {"零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}
#: How article numbers and dates are written.
CN = "[零一二三四五六七八九十百千]+"
ARABIC_ARTICLE = r"(?U)第\s*(\d+)(?:\s*-\s*(\d+))?\s*條"
CHINESE_ARTICLE = rf"(?U)第\s*({CN})\s*條(?:\s*之\s*({CN}))?"
BRANCH_BEFORE = rf"(?U)第\s*({CN})\s*之\s*({CN})\s*條"
ROC_DAY = r"(?U)民國\s*(\d+)\s*年\s*(\d+)\s*月\s*(\d+)\s*日"
ROC_MONTH = r"(?U)民國\s*(\d+)\s*年\s*(\d+)\s*月"
ROC_YEAR = r"(?U)民國\s*(\d+)\s*年"
#: How statutes stand in the lines and the heading block of a decision.
RELATED_START, RELATED_END, RELATED_END_SHORT = r"(?U)相關法條[：:]\s*$", r"(?U)^\s*全\s*文", r"(?U)^\s*全"
STATUTE_LINE = r"(?U)(.+?法|.+?條例|.+?規則|.+?辦法)\s*第\s*([\d、,\s]+)\s*條"

#: Headings of a decision's sections, the labels of rulings, names of courts and numbers of rulings.
SECTION_HEADS = {"main_text": "主文", "facts": "事實", "reasons": "理由"}
STATUTE_TITLE = r"(?U)法規名稱[：:]\s*([^\n]+)"
AUTHORITY = r"(?U)(法務部|內政部|行政院[^\s]*|[^\s]+部)"
LETTER_NO = r"(?U)(法律字第\s*[\d]+\s*號|[一-\u9fff]*字第\s*[\d]+\s*號)"
LETTER_DATE = r"(?U)(民國\s*\d+\s*年\s*\d+\s*月\s*\d+\s*日)"
LETTER_SUMMARY = r"(?U)要\s*旨[：:]?\s*\n?\s*([^\n]+)"
COURT = r"(?U)(最高行政法院|臺北高等行政法院|高雄高等行政法院|臺灣[^\s]+法院|司法院|釋字)"
RULING_NO = r"(?U)(\d+\s*年度[^\-]*?號|第\s*\d+\s*號解釋)"
#: Markdown marks that are taken out of a model's text, with what stays of them.
MARKDOWN = [(r"\*\*([^\n]+?)\*\*", "$1"), (r"(?m)^#{1,6}\s*", ""), (r"(?m)^\s*[-*]\s+", "")]


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalise(c: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """Search form of a text: one kind of space and line end, runs shortened, aliases replaced; null is ''."""
    c = F.coalesce(c, F.lit(""))
    c = F.regexp_replace(F.replace(c, F.lit("　"), F.lit(" ")), "\r\n?", "\n")
    c = F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n{3,}", "\n\n")
    for a, b in aliases.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, "^[ \n\t]+|[ \n\t]+$", "")


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """A pattern's first capture, null where it does not match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))


def numeral(c: Column) -> Column:
    """A Chinese numeral below ten thousand as a number; null for 0 and for other characters.

    A digit replaces the digit before it; a unit counts the digit before it, or one.
    """
    digits = F.create_map(*[F.lit(x) for kv in DIGITS.items() for x in kv])
    units = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("cur"), F.lit(False).alias("bad"))

    def step(s, x):
        d, u = F.try_element_at(digits, x), F.try_element_at(units, x)
        added = s["sum"] + F.when(s["cur"] == 0, F.lit(1)).otherwise(s["cur"]) * u
        return F.struct(
            F.when(u.isNotNull(), added).otherwise(s["sum"]).alias("sum"),
            F.when(u.isNotNull(), F.lit(0)).otherwise(F.coalesce(d, s["cur"])).alias("cur"),
            (s["bad"] | (u.isNull() & d.isNull())).alias("bad"),
        )

    letters = F.filter(F.split(c, ""), lambda x: x != "")
    return F.aggregate(letters, start, step, lambda s: F.when(s["bad"], F.lit(None)).otherwise(F.nullif(s["sum"] + s["cur"], F.lit(0))))


def article_key(c: Column, branch_before: bool = False) -> Column:
    """'15' or '15-2' of an article number, Arabic first, then Chinese with its branch behind 條.

    branch_before also takes the form 第十五之二條, as citations write it.
    """
    c = F.replace(c, F.lit("　"), F.lit(" "))
    keys = [F.concat_ws("-", first_match(c, ARABIC_ARTICLE, 1), first_match(c, ARABIC_ARTICLE, 2))]
    for pattern in (CHINESE_ARTICLE, BRANCH_BEFORE)[: 1 + branch_before]:
        main, branch = (numeral(first_match(c, pattern, k)) for k in (1, 2))
        keys.append(F.when(main.isNotNull(), F.concat_ws("-", main.cast("string"), branch.cast("string"))))
    return F.coalesce(F.nullif(keys[0], F.lit("")), *keys[1:])


def roc_date(c: Column) -> Column:
    """struct(raw, calendar, iso, precision, roc_year) of a date in the Minguo calendar: the fullest that the text has.

    Days and months are not checked against a calendar.
    """
    day, month, year = (first_match(c, p, 0).isNotNull() for p in (ROC_DAY, ROC_MONTH, ROC_YEAR))
    part = lambda p, k: first_match(c, p, k).cast("int")
    precision = F.when(day, "day").when(month, "month").when(year, "year").otherwise("unknown")
    iso = F.when(day, F.format_string("%04d-%02d-%02d", part(ROC_DAY, 1) + 1911, part(ROC_DAY, 2), part(ROC_DAY, 3)))
    roc_year = F.when(day, part(ROC_DAY, 1)).when(month, part(ROC_MONTH, 1)).otherwise(part(ROC_YEAR, 1))
    return F.struct(c.alias("raw"), F.lit("roc").alias("calendar"), iso.alias("iso"), precision.alias("precision"), roc_year.alias("roc_year"))


def roc_year(c: Column) -> Column:
    """The first year of the Minguo calendar that a text names."""
    return first_match(c, ROC_YEAR, 1).cast("int")


def base_name(c: Column) -> Column:
    """A path's last part without the suffix of its file type, that of a copy included."""
    name = F.element_at(F.split(c, "/"), -1)
    return F.regexp_replace(F.regexp_replace(name, r"\.pdf( 的副本)?\.pdf$", ""), r"\.[A-Za-z][A-Za-z0-9]{0,4}$", "")


def file_hint(c: Column) -> Column:
    """struct(raw, seq, year, kind, basis, result) of names such as '3.112年-kind-basis-result.pdf'."""
    raw = base_name(c)
    parts = F.split(raw, "-")
    head, n = F.element_at(parts, 1), F.size(parts)
    return F.struct(
        raw.alias("raw"), first_match(head, r"^(\d+)\.(\d+)年", 1).cast("int").alias("seq"), first_match(head, r"^(\d+)\.(\d+)年", 2).cast("int").alias("year"),
        F.when(n > 1, strip(F.element_at(parts, 2))).alias("kind"), F.when(n > 2, strip(F.element_at(parts, 3))).alias("basis"),
        F.when(n > 1, strip(F.element_at(parts, -1))).alias("result"),
    )


def folder_type(folder: Column) -> Column:
    """The document type of a folder, 'unknown' for others."""
    known = F.create_map(*[F.lit(x) for kv in R.FOLDER_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, folder), F.lit("unknown"))


def subtype(kind: Column, path: Column) -> Column:
    """The finer type of a ruling by its file name; null for other documents."""
    name = F.element_at(F.split(path, "/"), -1)
    ruling = F.when(name.contains("釋字") | F.substring(name, 1, 20).contains("解釋"), "interpretation_constitutional")
    ruling = ruling.when(name.contains("裁定"), "ruling").when(name.contains("判決"), "judgment")
    return F.when(kind == "precedent", ruling).when(kind == "interpretation", "administrative_letter")


def labelled(c: Column, label: str) -> Column:
    """The rest of the line behind `label：`, or the next line; null if the text has no such label."""
    mark = re.escape(label)
    return tidy(first_match(c, rf"(?U){mark}[：:]\s*\n?\s*([^\n]+)"))


def tidy(c: Column) -> Column:
    """Runs of spaces and of empty lines shortened, ends stripped; null stays null."""
    c = F.regexp_replace(F.replace(c, F.lit("　"), F.lit(" ")), "[ \t]+", " ")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def known_names(c: Column, names: list[str], aliases: dict[str, str] = ALIASES) -> Column:
    """The names that a text holds, in the order of `names`, variants under the name they stand for."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(c.contains(n), F.lit(aliases.get(n, n))) for n in names])))


def statute_articles(line: Column, anchored: bool = False) -> Column:
    """array of struct(name, num): the statute and the article numbers of a line such as 某法 第 5、7 條.

    Only the first such statute counts; anchored ones have to start the line.
    """
    c = strip(line)
    pattern = ("^" if anchored else "") + STATUTE_LINE
    name, nums = strip(first_match(c, pattern, 1)), F.regexp_extract_all(F.coalesce(first_match(c, pattern, 2), F.lit("")), F.lit(r"\d+"), F.lit(0))
    return F.transform(nums, lambda n: F.struct(name.alias("name"), n.cast("int").alias("num")))


def case_type_form(c: Column) -> Column:
    """A case type without the words that all of them have, and with one spelling; '' for null."""
    c = F.coalesce(c, F.lit(""))
    for a, b in (("違反", ""), ("事件", ""), ("空氣汙染", "空氣污染")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return strip(c)


def parent_word(c: Column) -> Column:
    """The first keyword of a parent law in a case type; null without one."""
    return ladder(F.replace(c, F.lit("空氣汙染"), F.lit("空氣污染")), [(w, w) for w in R.PARENT_WORDS])


def parent_statute(c: Column) -> Column:
    return ladder(c, R.PARENT_STATUTES)


def case_type(c: Column) -> Column:
    return ladder(c, R.CASE_TYPES)


def whole_number(c: Column) -> Column:
    """A number in text; null for '', 0 and what is no whole number."""
    return F.nullif(strip(c).try_cast("int"), F.lit(0))


def snippet(summary: Column, content: Column, most: int = 600) -> Column:
    """The summary, else the content: one kind of space, no empty lines, at most so many characters."""
    body = F.coalesce(F.nullif(summary, F.lit("")), content, F.lit(""))
    body = F.regexp_replace(F.regexp_replace(body, "[\u00a0\u3000]+", " "), "\n{2,}", "\n")
    return F.substring(strip(body), 1, most)


def outcome(reason: Column) -> Column:
    """The main text that the end of a reason tells."""
    end = F.right(reason, F.lit(200))
    asked = F.lit("（請承辦人確認主文）")
    found = F.when(end.contains("撤銷"), "原處分撤銷。").when(end.contains("不受理"), "訴願不受理。")
    return found.when(end.contains("駁回") | end.contains("無理由"), "訴願駁回。").otherwise(asked)


#: Words at which a model's text starts to speak of itself.
STOPS = ["Review against", "strict constraint", "constraints", "以下是我的", "檢查清單", "checklist", "let me ", "I will ", "作為承辦人，我", "（僅供你遵循", "撰寫規範"]


def scrubbed(c: Column) -> Column:
    """A model's text up to the first line that speaks of itself, without Markdown marks."""
    lines = F.split(F.coalesce(c, F.lit("")), "\n")
    stop = F.transform(lines, lambda x: F.lower(x).rlike("|".join(re.escape(w.lower()) for w in STOPS)))
    at = F.array_position(stop, True)
    kept = F.array_join(F.when(at > 0, F.slice(lines, F.lit(1), (at - 1).cast("int"))).otherwise(lines), "\n")
    for pattern, to in (*MARKDOWN, ("\n{3,}", "\n\n")):
        kept = F.regexp_replace(kept, pattern, to)
    return strip(kept)


def statute_title(first_page: Column, path: Column) -> Column:
    """A statute's name from its first page, else from its file name."""
    title = F.regexp_replace(strip(first_match(first_page, STATUTE_TITLE)), r"(?U)\s*EN\s*$", "")
    return F.coalesce(title, base_name(path))


def related_lines(c: Column) -> Column:
    """The statute lines between a line that ends in 相關法條： and the next that starts with 全文, or else with 全; none without both."""
    lines = F.split(F.coalesce(c, F.lit("")), "\n")
    where = lambda pattern, at: F.array_position(F.transform(at, lambda x: x.rlike(pattern)), True)
    begin = where(RELATED_START, lines).cast("int")
    rest = F.slice(lines, begin + 1, F.size(lines))
    end = F.coalesce(*[F.nullif(where(p, rest), F.lit(0)) for p in (RELATED_END, RELATED_END_SHORT)], F.lit(1)).cast("int")
    block = F.when(begin > 0, F.slice(rest, F.lit(1), end - 1)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(block, tidy), lambda x: x != "")


def three_sections(c: Column) -> Column:
    """struct(main_text, facts, reasons): the text behind the first line that is a section's heading, up to the next such first line.

    A heading that comes again is text of the section it stands in.
    """
    found = {}
    for name, head in SECTION_HEADS.items():
        pattern = rf"(?Us)\A(.*?)(\n\s*{r'\s*'.join(head)}\s*\n)"
        before, line = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
        found[name] = F.when(line != "", F.struct(F.length(before).alias("start"), (F.length(before) + F.length(line)).alias("end")))
    starts = F.array_compact(F.array(*[x["start"] for x in found.values()]))

    def section(x: Column) -> Column:
        stop = F.coalesce(F.array_min(F.filter(starts, lambda s: s > x["start"])), F.length(c))
        return F.when(x.isNotNull(), tidy(F.substring(c, x["end"] + 1, F.greatest(stop - x["end"], F.lit(0)))))

    return F.struct(*[section(x).alias(name) for name, x in found.items()])


def interpretation_fields(text: Column) -> Column:
    """struct(issuing_authority, doc_no, doc_date, summary) of an administrative interpretation."""
    fields = {"issuing_authority": AUTHORITY, "doc_no": LETTER_NO, "doc_date": LETTER_DATE, "summary": LETTER_SUMMARY}
    return F.struct(*[tidy(first_match(text, p)).alias(name) for name, p in fields.items()])


def precedent_fields(path: Column) -> Column:
    """struct(doc_id, court, case_no, topic) of a ruling, from its file name."""
    name = base_name(path)
    topic = F.when(name.contains("-"), tidy(F.substring(name, F.instr(name, "-") + 1, F.length(name))))
    return F.struct(name.alias("doc_id"), tidy(first_match(name, COURT)).alias("court"), tidy(first_match(name, RULING_NO)).alias("case_no"), topic.alias("topic"))


def joined(*parts: Column) -> Column:
    """The parts that are neither null nor empty, joined by spaces."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def statute_index_text(name: Column, number: Column, content: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (name, number, content)])


def decision_index_text(kind: Column, summary: Column, related: Column, facts: Column, reasons: Column) -> Column:
    return joined(kind, summary, F.array_join(related, " "), F.substring(facts, 1, 800), F.substring(reasons, 1, 800))


def reference_index_text(authority: Column, topic: Column, summary: Column, content: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (authority, topic, summary, F.substring(content, 1, 1200))])


def query_text(kind: Column, facts: Column, claims: Column, full: Column | None = None) -> Column:
    """What is searched for an appeal; references are searched without its full text."""
    return joined(kind, facts, claims, *([F.substring(full, 1, 500)] if full is not None else []))


def ladder(c: Column, rules: list[tuple[str, str]], other: str | None = None) -> Column:
    """The label of the first rule whose keyword the text contains."""
    out = F.lit(other)
    for word, label in reversed(rules):
        out = F.when(c.contains(word), F.lit(label)).otherwise(out)
    return out
