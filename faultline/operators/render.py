"""Prompt and report rendering per row.

Templates are filled with ``concat`` over columns; the diagram catalogue is
a literal (a bounded string), not a join. Interpolation follows template
strings: null prints as 'null'.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The analysis request text around the accident description.
PROMPT_HEAD = (
    "다음 교통사고를 분석해주세요.\n\n"
    "★ 반드시 STEP 1(카테고리 확정) → STEP 2(도표 선택) 순서를 따르십시오.\n"
    "★ STEP 1에서 확정된 도표 ID 범위 밖의 도표는 절대 선택하지 마십시오.\n"
    "★ A/B 과실비율은 반드시 도표의 A/B 정의를 따르십시오 (사용자 입력의 A/B 순서가 아님).\n\n"
    "## 사고 상황\n"
)
PROMPT_LIST = "\n\n## 사용 가능한 도표 목록\n"

# The report request lines.
REPORT_HEAD = "다음 분석 결과를 바탕으로 감정서 종합 의견을 작성해주세요:\n\n"
REPORT_TAIL = (
    "\n\n아래 항목을 포함하여 작성:\n"
    "1. 사고 유형 판단 근거\n"
    "2. 과실비율 인정기준 적용 설명\n"
    "3. 과실비율 산정 논리\n"
    "4. 수정요소 적용 근거\n"
    "5. 유사 판례 인용 (있는 경우)\n"
    "6. 법적 근거 설명 (도로교통법, 민법 등)\n"
    "7. 유의사항 및 참고사항"
)
NONE_TEXT = "없음"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tmpl(x) -> Column:
    """``${x}``: null prints as 'null'."""
    return F.coalesce(_c(x).cast("string"), F.lit("null"))


def render_prompt(text, catalogue: str) -> Column:
    """The per-accident request with the diagram catalogue appended."""
    return F.concat(F.lit(PROMPT_HEAD), tmpl(text), F.lit(PROMPT_LIST), F.lit(catalogue))


def join_or_none(*arrays) -> Column:
    """``(a || b || []).join(', ') || '없음'`` -- an empty array is truthy."""
    arr = F.coalesce(*[_c(a) for a in arrays], F.array().cast("array<string>"))
    return F.coalesce(F.nullif(F.array_join(arr, ", "), F.lit("")), F.lit(NONE_TEXT))


def render_report(category, diagram_title, diagram_id, label_a, label_b, base_fault_a, base_fault_b,
                  fault_a, fault_b, modifiers, detected_modifiers, modifier_detail, precedent_refs,
                  input_text) -> Column:
    """The report request text for one analysis row."""
    detail = F.coalesce(F.to_json(_c(modifier_detail)), F.lit("[]"))
    return F.concat(
        F.lit(REPORT_HEAD),
        F.lit("사고 유형: "), tmpl(category), F.lit(" — "), tmpl(diagram_title), F.lit("\n"),
        F.lit("적용 도표: "), tmpl(diagram_id), F.lit("\n\n"),
        F.lit("기본 과실비율: "), tmpl(label_a), F.lit(" "), tmpl(base_fault_a), F.lit("% : "),
        tmpl(label_b), F.lit(" "), tmpl(base_fault_b), F.lit("%\n"),
        F.lit("수정요소: "), join_or_none(modifiers, detected_modifiers), F.lit("\n"),
        F.lit("수정요소 상세: "), detail, F.lit("\n"),
        F.lit("최종 과실비율: "), tmpl(label_a), F.lit(" "), tmpl(fault_a), F.lit("% : "),
        tmpl(label_b), F.lit(" "), tmpl(fault_b), F.lit("%\n"),
        F.lit("유사 판례: "), join_or_none(precedent_refs), F.lit("\n"),
        F.lit("사고 상황: "), tmpl(input_text),
        F.lit(REPORT_TAIL),
    )
