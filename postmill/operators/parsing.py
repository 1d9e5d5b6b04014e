"""Facts out of free texts: postings, profile drafts, marked sections. All native but for HTML blocks."""

from __future__ import annotations

from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from ..functions.dates import published_date
from ..functions.text import bound, lines, tags
from .matching import FACTS
from .windows import context_frame, merge_lines

#: Wordings (fixed values).
LABELS = {
    "company": "公司(?:名称)?|企业(?:名称)?|company",
    "title": r"岗位(?:名称)?|职位(?:名称)?|招聘岗位|job\s*title|title",
    "city": "工作(?:城市|地点)|城市|地点|location",
    "salary_raw": "薪资(?:待遇|范围)?|薪酬(?:范围)?|salary",
    "experience": "工作经验|经验(?:要求)?|experience",
    "education": "学历(?:要求)?|education",
}
COMPANY = "(?i)^.{2,60}(?:有限责任公司|股份有限公司|有限公司|科技公司)$"
ROLE = "(?i)工程师|研究员|科学家|算法|研发|scientist|engineer"
NOT_TITLE = r"^(?:[\d一二三四五]+[.、)]|负责|要求|熟悉|精通)"
CITY = "(?i)(深圳|北京|上海|杭州|广州|成都|南京|武汉|苏州|西安|香港|远程|remote)"
PAY_LINE = r"([^\n]*(?:\d+(?:\.\d+)?\s*[-–—~～至]\s*\d+(?:\.\d+)?\s*[kK万千元]|薪资面议|薪酬面议|年薪|年包)[^\n]*)"
YEARS = r"(\d+\s*[-–—~～至]\s*\d+\s*年(?:以上)?(?:经验)?|\d+\s*年(?:以上)?(?:工作)?经验|经验不限)"
DEGREE = "((?:博士|硕士|本科|大专)(?:及以上|以上|学历)?|学历不限)"
HEADING = r"(?i)^(?:[一二三四五\d]+[、.．)]\s*)?(岗位职责|工作职责|职位描述|工作内容|职责|responsibilities|任职要求|职位要求|岗位要求|任职资格|技能要求|要求|qualifications|requirements)\s*[:：]?\s*(.*)$"
WANTED = "(?i)要求|资格|qualifications|requirements"
STOP = r"^(?:福利|公司介绍|薪资|薪酬|工作地点|联系方式|投递方式)\s*[:：]"


def duties_and_requirements(rows: Column) -> Column:
    """A struct of two line arrays: a heading opens a section (and may bring its first line), a stop heading closes it."""
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("now"), empty.alias("duties"), empty.alias("requirements"))

    def step(state: Column, line: Column) -> Column:
        opens, closes = line.rlike(HEADING), line.rlike(STOP)
        kind = F.when(F.regexp_extract(line, HEADING, 1).rlike(WANTED), "requirements").otherwise("duties")
        now = F.when(opens, kind).when(closes, "").otherwise(state["now"])
        add = F.when(opens, F.nullif(F.regexp_extract(line, HEADING, 2), F.lit(""))).when(~closes, line)
        more = lambda name: F.when((now == name) & add.isNotNull(), F.concat(state[name], F.array(add))).otherwise(state[name])
        return F.struct(now.alias("now"), more("duties").alias("duties"), more("requirements").alias("requirements"))

    return F.aggregate(rows, start, step)


def parse_postings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each text: nine facts and uncertain_fields.

    Explicit labels first, then candidates; what isn't labelled is told as uncertain."""
    t, first = F.col("_t"), lambda pattern: F.regexp_extract(F.col("_t"), pattern, 1)
    df = merge_lines(df.select(id_col, text_col), id_col, [text_col], "_t").withColumn("_l", lines(t))
    label = {f: F.trim(F.regexp_extract(t, rf"(?im)^(?:{p})\s*[:：]\s*(.+)$", 1)) for f, p in LABELS.items()}
    some = lambda test: F.coalesce(F.try_element_at(F.filter("_l", test), F.lit(1)), F.lit(""))
    title = F.coalesce(F.try_element_at(F.filter(F.slice("_l", 1, 8), lambda x: (F.length(x) < 60) & x.rlike(ROLE) & ~x.rlike(NOT_TITLE)), F.lit(1)), F.lit(""))
    guess = {"company": some(lambda x: x.rlike(COMPANY)), "title": title, "city": first(CITY), "salary_raw": F.trim(first(PAY_LINE)), "experience": first(YEARS), "education": first(DEGREE)}
    df = df.withColumns({f"_{f}": x for f, x in label.items()} | {"_s": duties_and_requirements(F.col("_l")), "published_at": published_date(t)})
    facts = {f: F.when(F.col(f"_{f}") != "", F.col(f"_{f}")).otherwise(guess[f]) for f in LABELS}
    facts |= {"responsibilities": F.array_join("_s.duties", "\n"), "requirements": F.array_join("_s.requirements", "\n"), "published_at": F.col("published_at")}
    sure = {f: F.col(f"_{f}") != "" for f in LABELS} | {"responsibilities": F.size("_s.duties") > 0, "requirements": F.size("_s.requirements") > 0, "published_at": F.col("published_at") != ""}
    uncertain = F.array_compact(F.array(*[F.when(~sure[f], F.lit(f)) for f in FACTS]))
    return df.select(id_col, *[facts[f].alias(f) for f in FACTS], uncertain.alias("uncertain_fields"))


def draft_profiles(df: DataFrame, id_col: str, text_col: str, vocabulary: dict[str, list[str]], projects: int = 9) -> DataFrame:
    """A draft of a profile from a text: contact, name, years, skills with a quote, project candidates; nothing is confirmed."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    contact = F.array_join(F.filter(F.array(F.regexp_extract(t, r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", 1), F.regexp_extract(t, r"(?<!\d)(1[3-9]\d{9})(?!\d)", 1)), lambda x: x != ""), " | ")
    number = F.regexp_extract(t, r"(\d+(?:\.\d+)?)\s*年(?:以上)?(?:工作|算法|相关)?经验", 1).try_cast("double")
    years = F.when(number.isNotNull(), F.least(number, F.lit(70.0)))
    quote = lambda name: F.coalesce(F.try_element_at(F.filter(lines(t), lambda x: F.lower(x).contains(F.lower(name))), F.lit(1)), F.lit("简历含相关术语，需用户核对实践程度"))
    skills = F.transform(tags(t, vocabulary), lambda n: F.struct(n.alias("name"), F.lit("unknown").alias("level"), F.substring(quote(n), 1, 1000).alias("evidence"), F.lit(False).alias("confirmed")))
    chunks = F.slice(F.split(t, r"(?m)^\s*(?:项目名称|项目经历|项目)\s*[:：]\s*"), 2, projects)
    rows = F.transform(chunks, lambda c: F.filter(F.transform(lines(c), lambda x: F.trim(x)), lambda x: x != ""))
    found = F.transform(F.filter(rows, lambda r: F.size(r) > 0), lambda r: F.struct(F.substring(r[0], 1, 150).alias("title"), F.slice(r, 2, 15).alias("bullets"), F.lit(False).alias("confirmed")))
    return df.select(id_col, contact.alias("contact"), F.trim(F.regexp_extract(t, r"(?i)(?:姓名|Name)\s*[:：]\s*([^\n]+)", 1)).alias("name"), years.alias("years"), skills.alias("skills"), found.alias("projects"))


_BLOCKS = ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6")


class _Blocks(HTMLParser):
    """Paragraphs, list items and headings as (text, whether a heading); bold text that is a whole block is one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, bool]] = []
        self.open, self.bold, self.skip = None, 0, 0
        self.parts: list[str] = []
        self.strong: list[str] = []

    def flush(self):
        text = " ".join(self.parts)
        if text:
            self.out.append((text, bool(self.open and self.open[0] == "h") or bool(self.open and text == " ".join(self.strong) and len(text) < 100)))
        self.open, self.parts, self.strong = None, [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in _BLOCKS and not self.open:
            self.flush()
            self.open = tag
        elif tag in ("strong", "b"):
            self.bold += 1

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == self.open:
            self.flush()
        elif tag in ("strong", "b"):
            self.bold = max(0, self.bold - 1)

    def handle_data(self, data):
        text = data.strip()
        if text and not self.skip:
            self.parts.append(text)
            if self.bold:
                self.strong.append(text)
            if not self.open:
                self.flush()


def blocks_of(markup: str | None) -> list[tuple[str, bool]]:
    text = unescape(markup or "")
    if "<" not in text:
        return [(x.strip(), False) for x in (markup or "").splitlines() if x.strip()]
    parser = _Blocks()
    parser.feed(text)
    parser.close()
    parser.flush()
    return parser.out


@F.pandas_udf(ArrayType(StructType([StructField("text", StringType()), StructField("heading", BooleanType())])))
def html_blocks(markup: pd.Series) -> pd.Series:
    return markup.map(lambda x: [{"text": t, "heading": h} for t, h in blocks_of(x)])


#: Complete headings of sections (fixed values).
DUTY_HEADS = "(?:key |core |your |primary )?(?:responsibilities|duties)|essential duties(?: and responsibilities)?|what (?:you['’]ll|you will) (?:do|be doing)|the role|about (?:the|this) role|岗位职责|工作职责|职位职责|工作内容|职责"
WANTED_HEADS = "(?:(?:minimum|required|basic|preferred|bonus|desired|additional|key|technical) )?(?:qualifications|requirements|skills)|what (?:you['’]ll|you will) bring|what we['’]re looking for|who you are|you (?:may be|might be) a good fit if|nice[- ]to[- ]haves?|bonus points|任职要求|任职资格|岗位要求|职位要求|技能要求|基本要求|优先条件|加分项"
STOP_HEADS = "(?:our |your )?(?:benefits|compensation|salary|perks)|compensation and benefits|about (?:us|the company)|why (?:join|work)|how to apply|application process|equal opportunity|公司介绍|关于我们|福利(?:待遇)?|薪资(?:待遇)?|薪酬(?:福利)?|投递方式|工作地点"


def board_sections(blocks: Column) -> Column:
    """A struct of duties and requirements (line arrays) from blocks; an unknown heading closes a section too."""
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("now"), empty.alias("duties"), empty.alias("requirements"))

    def step(state: Column, block: Column) -> Column:
        line = block["text"]
        label = F.trim(F.split(F.trim(F.regexp_replace(line, r"^(?:[一二三四五\d]+[、.．)]\s*)", "")), "[:：]", 2)[0])
        is_ = lambda heads: label.rlike(rf"(?i)\A(?:{heads})\z")
        closes = is_(STOP_HEADS) | block["heading"] | line.rlike(r"(?i)^(?:The (?:US )?(?:base )?salary|The pay offered|We are an equal opportunity)")
        now = F.when(is_(DUTY_HEADS), "duties").when(is_(WANTED_HEADS), "requirements").when(closes, "").otherwise(state["now"])
        more = lambda name: F.when(now == name, F.concat(state[name], F.array(line))).otherwise(state[name])
        return F.struct(now.alias("now"), more("duties").alias("duties"), more("requirements").alias("requirements"))

    return F.aggregate(blocks, start, step)


def degree_lines(rows: Column) -> Column:
    return F.array_distinct(F.filter(rows, lambda x: x.rlike(r"(?i)(?<![\p{L}\p{N}_])(?:bachelor(?:['’]s|s)?|master(?:['’]s|s)(?![\p{L}\p{N}_])|master\s+(?:degree|of)|ph\.?d\.?|b\.?s\.?|m\.?s\.?|b\.?sc\.?|m\.?sc\.?)(?![\p{L}\p{N}_])|博士|硕士|本科|大专|学历不限")))


def experience_lines(rows: Column) -> Column:
    return F.array_distinct(F.filter(rows, lambda x: x.rlike(r"(?i)(?<![\p{L}\p{N}_])\d+(?:\.\d+)?\s*(?:\+|[-–—]\s*\d+)?\s*(?:years?|yrs?)(?![\p{L}\p{N}_]).{0,100}(?:experience|expertise|background)|experience\s*[:：]\s*\d+\+?\s*years?|\d+\s*(?:[-–—至]\s*\d+)?\s*年(?:以上)?[^\n。]{0,30}经验|经验不限")))


#: Patterns of the facts that a board's lines tell (fixed values).
QUALITATIVE = r"(?iU)\b(?:extensive|significant|proven|demonstrated)\s+(?:professional\s+|industry\s+)?experience\b"
DEGREE_CUE = r"(?i)degree|学历|学位|及以上|要求|优先|需|preferred|required|equivalent"


def board_facts(blocks: Column) -> Column:
    """A struct of responsibilities, requirements, experience and education as texts, from blocks.

    Experience and education are told by the lines of the requirements, else by any line: then words like "proven experience" don't count, and a
    degree only next to a word that asks for it. Whole lines are kept, each once."""

    def told(x: Column) -> Column:
        wanted = x["requirements"]
        some = F.size(wanted) > 0
        from_ = F.when(some, wanted).otherwise(x["every"])
        years = F.filter(from_, lambda line: F.array_contains(x["years"], line) | (some & line.rlike(QUALITATIVE)))
        degrees = degree_lines(from_)
        degrees = F.when(some, degrees).otherwise(F.filter(degrees, lambda line: line.rlike(DEGREE_CUE)))
        text = lambda rows: F.array_join(rows, "\n")
        return F.struct(text(x["duties"]).alias("responsibilities"), text(wanted).alias("requirements"), text(F.array_distinct(years)).alias("experience"), text(degrees).alias("education"))

    every = F.transform(blocks, lambda b: b["text"])
    sections = bound(blocks, board_sections)
    return bound(F.struct(sections["duties"].alias("duties"), sections["requirements"].alias("requirements"), every.alias("every"), experience_lines(every).alias("years")), told)


def pay_excerpt(content: Column) -> Column:
    """The first line that names pay and an amount, with two lines before it and one behind; 未知 if there is none."""
    names = r"(?i)salary|薪资|月薪|年薪|compensation range"
    amount = r"[$￥¥€£]\s*\d|\d[\d,]*(?:\.\d+)?\s*[kK万]|\d[\d,]{3,}"
    return F.coalesce(F.array_join(context_frame(content, lambda line: line.rlike(names) & line.rlike(amount)), "\n"), F.lit("未知"))
