"""Expansion of spoken queries by the terms that rules use."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pattern, terms. In order; a query may call up several.
ALIAS_RULES = (
    (r"(?:아이|자녀).{0,18}(?:돌보|키우|양육|쉬|휴직)", "자녀 양육 육아휴직"),
    (r"주말", "토요일 휴일 유급휴일 무급휴일"),
    (r"(?:피.{0,8}(?:뽑|기부)|혈액.{0,8}기부|헌혈)", "헌혈 공가"),
    (r"(?:퇴사|그만두|퇴직).{0,18}(?:정산금|돈|금액|언제)", "퇴직 퇴직금 지급 시기"),
    (r"(?:퇴사|그만두|퇴직).{0,18}(?:나이|몇\s*살|연령)", "정년 퇴직 나이"),
    (r"(?:마감|납품|계약).{0,30}(?:늦|지연|지체|못\s*지)", "계약 의무 지체"),
    (r"(?=.*(?:마감|납품|계약|업체|지연|지체|늦))(?=.*(?:페널티|패널티|벌금|위약금))", "지체상금"),
    (r"(?=.*(?:마감|납품|계약|지연|지체|늦))(?=.*(?:잘못|책임).{0,5}(?:없|아니))", "계약상대자 책임 없는 사유"),
    (r"(?:내부고발|공익제보|공익신고)", "공익신고 공익신고자"),
    (r"(?:정체|신분|인적사항).{0,15}(?:공개|알리|까발|누설)", "인적사항 신분 비밀보장 누설 금지"),
    (r"(?:신고|제보).{0,18}(?:보복|불이익)", "공익신고등을 이유로 임직원에게 불이익조치를 해서는 아니 된다 불이익조치 등의 금지"),
    (r"(?:따돌림|폭언|직장\s*내\s*괴롭힘|괴롭힘)", "직장 내 괴롭힘 신고 사건 접수 예방 대응 담당자"),
    (r"(?:자료|정보).{0,18}(?:보여|공개|열람)", "정보공개 청구"),
    (r"(?:정보|자료|공개).{0,24}(?:언제까지|기한|기간|며칠)", "공개여부 결정 통지 기간"),
    (r"(?:부모|가족|배우자).{0,24}(?:아프|아파|아픈|간병|돌보|보살피|보살펴)", "가족돌봄 휴직 가족돌봄 등을 위한 지원"),
    (r"(?:정보|자료|공개).{0,20}(?:거절|비공개)", "정보공개 비공개 결정"),
    (r"(?:거절|비공개).{0,20}(?:다시|따지|불복|이의)", "불복 이의신청"),
    (r"(?:집에서|재택|원격).{0,15}(?:컴퓨터|일|근무)", "재택근무 원격근무 유연근무"),
    (r"(?:견적\s*없이|한\s*(?:곳|업체).{0,12}(?:맡|계약)|바로\s*맡)", "수의계약 조건"),
)
LEAD = "\n관련 규정 용어: "


def expand_query(query: str) -> str:
    """The query with the terms of all rules that match it, each once; unchanged if none does."""
    terms = dict.fromkeys(t for p, t in ALIAS_RULES if re.search(p, query))
    return f"{query}{LEAD}{' '.join(terms)}" if terms else query


def expand_queries(queries: DataFrame, query: str = "query") -> DataFrame:
    """Adds ``expanded`` for a column of queries: one CASE per rule, no join. Null and empty ones stay as they are.

    A rule of conditions ahead is tried at the start of each line only: it fits there if it fits anywhere in the line.
    """
    at_line = lambda p: f"(?Um)^{p}" if p.startswith("(?=") else f"(?U){p}"
    terms = [F.when(F.regexp_like(query, F.lit(at_line(p))), F.lit(t)) for p, t in ALIAS_RULES]
    found = F.array_distinct(F.array_compact(F.array(*terms)))
    text = F.concat(F.col(query), F.lit(LEAD), F.array_join(found, " "))
    return queries.withColumn("expanded", F.when(F.size(found) > 0, text).otherwise(F.col(query)))
