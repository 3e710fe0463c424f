"""Mappings inferred from column names: schema matching over a column catalog.

columns: (source_id, file, sheet, column_idx, column), any number of tables. Each rule is a
small table; the first rule that holds wins, then the first column. The result is a table of
mapping specifications, small enough to collect and to run with operators.mapping.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.config import EntityMapping, Mapping, Property, RelationMapping

# Keywords of properties, classes and relations, in their order.
PROPERTY_RULES = (
    ("name", "string", ("name", "名称", "名字", "标题", "title", "公司", "机构", "学者", "论文", "领域", "行业")),
    ("year", "integer", ("year", "年份", "年度", "年")),
    ("cited_by_count", "integer", ("cited", "引用", "被引")),
    ("doi", "string", ("doi",)),
    ("country", "string", ("country", "国家", "国别")),
    ("region", "string", ("region", "地区", "区域", "省份", "城市", "所在地")),
    ("revenue", "decimal", ("revenue", "营收", "收入", "营业额", "销售额")),
    ("employees", "integer", ("employee", "员工", "人数", "职工")),
    ("level", "integer", ("level", "层级", "级别")),
    ("cnLabel", "string", ("cn", "中文", "中文名")),
    ("description", "string", ("desc", "描述", "说明", "简介", "摘要")),
)
CLASS_RULES = (
    ("Scholar", ("scholar", "author", "学者", "作者", "教师", "老师", "researcher", "研究人员")),
    ("Publication", ("publication", "paper", "论文", "文献", "文章", "work", "成果")),
    ("Institution", ("institution", "机构", "学校", "大学", "university", "院所")),
    ("Company", ("company", "corp", "公司", "企业", "厂商", "上市公司")),
    ("Industry", ("industry", "行业", "产业")),
    ("Field", ("field", "领域", "concept", "概念", "方向", "学科")),
    ("Venue", ("venue", "journal", "期刊", "会议", "刊物")),
)
VALUE_RELATIONS = (
    (("行业", "产业", "industry"), "belongsToIndustry", "Industry", "ind"),
    (("领域", "方向", "学科", "field", "concept"), "belongsToField", "Field", "f"),
    (("期刊", "会议", "刊物", "venue", "journal"), "publishedIn", "Venue", "v"),
)
#: Stem of a foreign key column: predicate, class at its end, whether the row is the object.
KEY_RELATIONS = (
    (("scholar", "author"), "authorOf", "Scholar", True),
    (("pub", "publication", "paper", "work"), "authorOf", "Publication", False),
    (("inst", "institution"), "affiliatedWith", "Institution", False),
)
PREFIXES = {"Scholar": "s", "Publication": "p", "Institution": "i", "Company": "c", "Field": "f", "Venue": "v", "Industry": "ind"}
ID_HINTS = ("id", "编号", "标识", "code", "key", "代码")
LABEL_EXACT = ("name", "名称", "名字", "title", "标题", "公司", "公司名称", "机构", "机构名称", "论文", "论文标题", "学者", "学者姓名", "项目名称", "产品名称")
LABEL_PARTS = ("name", "名称", "标题", "title")
DIMENSIONS = ("领域", "行业", "地区", "区域", "国家", "类别", "类型", "分类")
TABLE = ["source_id", "file", "sheet"]


def _norm(c: str) -> Column:
    return F.lower(F.trim(c))


def _any(c: Column, words: Sequence[str]) -> Column:
    return F.array_max(F.array(*[F.contains(c, F.lit(w)) for w in words]))


def _rank(c: Column, rules: Sequence[Sequence[str]]) -> Column:
    """Number of the first rule one of whose words c contains; null if none."""
    return F.coalesce(*[F.when(_any(c, words), F.lit(i)) for i, words in enumerate(rules)])


def infer(columns: DataFrame) -> DataFrame:
    """One row for each column: (source_id, file, sheet, column_idx, column, class, id_column, label_column, role, term, datatype, target).

    role: id, value_relation, key_relation, key_relation_inverse, property or unmapped; term: the
    property or predicate; target: class at the relation's other end. A table of no known
    class has class GenericRecord. A null sheet is a sheet of its own name ''.
    """
    c = columns.withColumn("sheet", F.coalesce("sheet", F.lit(""))).withColumn("n", _norm("column"))
    blob = F.lower(F.concat_ws(" ", "file", "sheet", F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column_idx", "column"))), lambda x: x["column"]), " ")))
    id_rank = F.when(F.col("n").isin("id", "openalex_id"), 0).when(_any(F.col("n"), ID_HINTS), 1).otherwise(2)
    tables = c.groupBy(*TABLE).agg(blob.alias("blob"), F.min_by("column", F.struct(id_rank, "column_idx")).alias("id_column"))
    classes = F.coalesce(F.get(F.array(*[F.lit(k) for k, _ in CLASS_RULES]), _rank(F.col("blob"), [w for _, w in CLASS_RULES])), F.lit("GenericRecord"))
    c = c.join(tables.select(*TABLE, classes.alias("class"), "id_column"), TABLE)

    is_id = F.col("column") == F.col("id_column")
    value = _rank(F.col("n"), [w for w, *_ in VALUE_RELATIONS])
    stem = F.when(F.col("n").endswith("_id"), F.regexp_replace("n", "_id", ""))
    key = F.coalesce(*[F.when(stem.isin(*stems), F.lit(i)) for i, (stems, *_) in enumerate(KEY_RELATIONS)])
    prop = _rank(F.col("n"), [w for *_, w in PROPERTY_RULES])
    pick = lambda rules, i, rank: F.get(F.array(*[F.lit(r[i]) for r in rules]), rank)
    c = c.withColumn("v", value).withColumn("k", key).withColumn("p", prop)
    role = F.when(is_id, "id").when(F.col("v").isNotNull(), "value_relation").when(F.col("k").isNotNull(), F.when(pick(KEY_RELATIONS, 3, F.col("k")), "key_relation_inverse").otherwise("key_relation")).when(F.col("p").isNotNull(), "property").otherwise("unmapped")
    c = c.withColumn("role", role)
    by_role = lambda v, k, p: F.when(F.col("role") == "value_relation", v).when(F.col("role").startswith("key_relation"), k).when(F.col("role") == "property", p)
    none = F.lit(None).cast("string")
    c = c.withColumn("term", by_role(pick(VALUE_RELATIONS, 1, F.col("v")), pick(KEY_RELATIONS, 1, F.col("k")), pick(PROPERTY_RULES, 0, F.col("p"))))
    c = c.withColumn("datatype", by_role(none, none, pick(PROPERTY_RULES, 1, F.col("p")))).withColumn("target", by_role(pick(VALUE_RELATIONS, 2, F.col("v")), pick(KEY_RELATIONS, 2, F.col("k")), none))

    label_rank = (
        F.when(F.col("n").isin(*LABEL_EXACT), 0).when(_any(F.col("n"), LABEL_PARTS) & ~F.contains("n", F.lit("id")), 1)
        .when(~is_id & ~_any(F.col("n"), DIMENSIONS) & ~F.col("n").endswith("_id"), 2).when(~is_id, 3)
    )
    label = c.withColumn("lr", label_rank).where("lr is not null").groupBy(*TABLE).agg(F.min_by("column", F.struct("lr", "column_idx")).alias("label_column"))
    return c.join(label, TABLE, "left").select(*TABLE, "column_idx", "column", "class", "id_column", "label_column", "role", "term", "datatype", "target")


def mappings_of(inferred: Sequence, include_unmapped: bool = False) -> tuple[list[Mapping], dict]:
    """Mappings and a summary from one table's rows of infer(), collected: as many rows as the table has columns.

    Foreign keys link the row's entity with the key's, in the relation's own direction.
    """
    rows = sorted(inferred, key=lambda r: r["column_idx"])
    if not rows:
        return [], {}
    cls, id_column = rows[0]["class"], rows[0]["id_column"]
    template = f"{PREFIXES.get(cls, 'e')}_{{id}}"
    properties = [Property(r["column"], r["term"], r["datatype"]) for r in rows if r["role"] == "property"]
    unmapped = [r["column"] for r in rows if r["role"] == "unmapped"]
    properties += [Property(c, "description") for c in unmapped] if include_unmapped else []
    out: list[Mapping] = [EntityMapping(cls, id_column, template, rows[0]["label_column"], tuple(p for p in properties if p.property != "name" or p.column != rows[0]["label_column"]))]
    for r in rows:
        other = f"{PREFIXES.get(r['target'], 'e')}_{{id}}"
        if r["role"] == "key_relation_inverse":
            out.append(RelationMapping(r["term"], r["target"], r["column"], other, cls, id_column, template))
        elif r["role"] in ("key_relation", "value_relation"):
            out.append(RelationMapping(r["term"], cls, id_column, template, r["target"], r["column"], other, from_value=r["role"] == "value_relation"))
    summary = {"class": cls, "id_column": id_column, "template": template, "label_column": rows[0]["label_column"], "properties": len(properties), "relations": [m.predicate for m in out[1:]], "unmapped": unmapped}
    return out, summary
