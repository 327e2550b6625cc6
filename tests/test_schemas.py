"""Domain schemas parse, and the operators accept frames of those shapes."""

from faultline.operators import accuracy as acc
from faultline.operators import ingest as ing
from faultline.operators import replies as rpl
from faultline.operators import reports as rep
from faultline.operators import search as srch
from faultline.sources import schemas


def test_all_schemas_parse(spark):
    for name in schemas.DDL:
        assert len(schemas.schema(name).fields) > 1


def test_operators_on_domain_shapes(spark):
    a = schemas.empty(spark, "analyses")
    shaped = ing.shape_analysis_records(a.drop("id", "created_at"))
    assert ing.with_generated_ids(shaped).count() == 0
    fb = schemas.empty(spark, "analysis_feedback")
    scored = acc.score_feedback(fb, "predicted_fault_a", "actual_fault_a", modifiers="modifiers_applied")
    assert set(acc.accuracy_by_key(scored, "knia_diagram").columns) == set(
        schemas.schema("diagram_accuracy").fieldNames()) - {"updated_at"}
    st = acc.diagram_stats(scored.withColumnRenamed("knia_diagram", "d"), "d")
    want = [f.name for f in schemas.schema("diagram_stats").fields if f.name not in ("avg_score", "last_updated")]
    assert st.columns == want
    v = rep.group_rounded_means(schemas.empty(spark, "video_training_data"), ["accident_place", "accident_type"],
                                {"avg_a": "rate_a", "avg_b": "rate_b"}, null_filter="rate_a")
    assert v.count() == 0
    p = schemas.empty(spark, "precedents").selectExpr("*", "array_join(keywords, ' ') AS keywords_text")
    assert srch.search(p, srch.SearchRequest(keywords="신호")).count() == 0
    r = spark.createDataFrame([('{"fault_a": 30}',)], "content string")
    typed = rpl.repair(r, "content").select(*rpl.typed_fields("reply"))
    assert typed.schema == schemas.schema("llm_reply")
