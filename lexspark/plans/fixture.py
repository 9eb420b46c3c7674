"""A small corpus of rule documents, written for this library's queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = (
    (
        "규정", "규정_시험규정.md", "규정_시험규정",
        "# 시험규정 (2025.03.01 개정)\n\n## 제1장 총칙\n### 제1조(목적) 이 규정은 시험 업무를 정한다.\n"
        "### 제2조(용어의 정의) ① 이 규정에서 쓰는 말의 뜻은\n다음과 같다.\n② 자세한 것은 제1조를 따른다.\n"
        "### 제2조의2(위원회) 「다른규정」 제3조에 따른다.\n부칙 <2025.03.01.>\n### 제1조(시행일) 이 규정은 공포한 날부터 시행한다.\n"
        "[별표 1] 처분 기준 [별지 제2호 서식] 신청서\n표 내용\n",
    ),
    (
        "시행세칙", "시행세칙_시험규정 시행세칙.md", "시행세칙_시험규정 시행세칙",
        "# 시험규정 시행세칙 (2024.01.15 개정)\n### 제1조(목적) 이 세칙은 「시험규정」에서 위임한 사항을 정한다.\n",
    ),
)

#: item_index, category, source, revision, chapter, article, no, sub, title, body, supplementary
ARTICLES = (
    (0, "규정", "시험규정", "2025.03.01 개정", "제1장 총칙", "제1조", 1, 0, "목적", "이 규정은 시험 업무를 정한다.", False),
    (1, "규정", "시험규정", "2025.03.01 개정", "제1장 총칙", "제2조", 2, 0, "용어의 정의", "① 이 규정에서 쓰는 말의 뜻은 다음과 같다.\n② 자세한 것은 제1조를 따른다.", False),
    (2, "규정", "시험규정", "2025.03.01 개정", "제1장 총칙", "제2조의2", 2, 2, "위원회", "「다른규정」 제3조에 따른다.", False),
    (3, "규정", "시험규정", "2025.03.01 개정", "제1장 총칙", "제1조", 1, 0, "시행일", "이 규정은 공포한 날부터 시행한다.", True),
    (4, "시행세칙", "시험규정 시행세칙", "2024.01.15 개정", "", "제1조", 1, 0, "목적", "이 세칙은 「시험규정」에서 위임한 사항을 정한다. 「시험규정」 제2조를 따른다.", False),
    (5, "지침", "계약지침", "2026.01.10 개정", "", "제1조", 1, 0, "목적", "「시험규정」에 따라 계약을 정한다. 시험규정 제2조의2와 제9조를 따른다.", False),
    (6, "지침", "외딴지침", "날짜 없음", "", "제1조", 1, 0, "목적", "「없는법」 제5조에 따른다.", False),
)

ATTACHMENTS = (
    (0, "규정", "시험규정", "2025.03.01 개정", "별표", "[별표 1]", "1", "처분 기준", "", False),
    (1, "규정", "시험규정", "2025.03.01 개정", "별지", "[별지 제2호 서식]", "제2호서식", "신청서", "표 내용", False),
    (2, "규정", "시험규정", "2025.03.01 개정", "별표", "[별표 10]", "10", "삭제", "<삭제 2024.01.01>", True),
)

#: one citation to a text, but for the last two
TEXTS = (
    (0, "시험규정 제2조의2(위원회)에 따라"), (1, "시험규정 제2조(정의)를 보면"), (2, "시험규정 제1조(예산)"), (3, "시험규정 부칙 제1조"), (4, "시험규정 제9조"),
    (5, "모르는규정 제1조"), (6, "시험규정 시행세칙 제1조"), (7, "시험규정 제1조(이하 '목적')"), (8, "인용이 없다"), (9, ""),
)

QUESTIONS = (
    ("q1", "시험", "시험규정", "위원회는 무엇인가", ["위원회", "업무"], "1", "근거: 시험규정 제2조의2"),
    ("q2", "시험", "시험규정", "업무는 누가 정하나", ["시험", "위원회"], "2", "근거: 시험규정 제1조"),
    ("q3", "시험", "다른규정", "없는 것", ["가", "나"], "1", "근거: 다른규정 제3조"),
)

ARTICLE_FIELDS = "item_index long, category string, source string, revision string, chapter string, article string, article_no int, article_sub int, article_title string, body string, is_supplementary boolean"
ATTACHMENT_FIELDS = "item_index long, category string, source string, revision string, kind string, label string, number string, title string, body string, deleted boolean"


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, "category string, file string, stem string, text string")


def articles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ARTICLES, ARTICLE_FIELDS)


def attachments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ATTACHMENTS, ATTACHMENT_FIELDS)


def texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEXTS, "text_id long, text string")


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "id string, category string, source string, question string, options array<string>, answer string, explanation string")


def sql_rows(rows: tuple, names: str) -> str:
    """The rows as a DuckDB subquery."""

    def value(x) -> str:
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, list):
            return "[" + ", ".join(map(value, x)) + "]"
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else "NULL" if x is None else str(x)

    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(value, r)) + ")" for r in rows) + f") AS v({names}))"


def sql_articles() -> str:
    return sql_rows(ARTICLES, ", ".join(c.split()[0] for c in ARTICLE_FIELDS.split(", ")))


def sql_attachments() -> str:
    return sql_rows(ATTACHMENTS, ", ".join(c.split()[0] for c in ATTACHMENT_FIELDS.split(", ")))
