"""A second mapping configuration: nine relational tables of bibliographic records."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.mapping import apply_mapping, union
from .config import EntityMapping, Mapping, Property, RelationMapping

_INT = "integer"
_ids = {"Institution": "institution/{id}", "Scholar": "scholar/{id}", "Publication": "publication/{id}", "Venue": "venue/{id}", "Field": "field/{id}"}


def _edge(predicate: str, subject: str, subject_column: str, target: str, target_column: str) -> RelationMapping:
    return RelationMapping(predicate, subject, subject_column, _ids[subject], target, target_column, _ids[target])


#: Table and its mapping.
STAR: tuple[tuple[str, Mapping], ...] = (
    ("institutions", EntityMapping("Institution", "openalex_id", _ids["Institution"], "name", (Property("country", "country"), Property("works_count", "worksCount", _INT), Property("cited_by_count", "citedByCount", _INT), Property("h_index", "hIndex", _INT)))),
    ("scholars", EntityMapping("Scholar", "openalex_id", _ids["Scholar"], "name")),
    ("publications", EntityMapping("Publication", "openalex_id", _ids["Publication"], "title", (Property("doi", "doi"), Property("year", "year", _INT), Property("cited_by_count", "cited_by_count", _INT)))),
    ("venues", EntityMapping("Venue", "openalex_id", _ids["Venue"], "name")),
    ("fields", EntityMapping("Field", "openalex_id", _ids["Field"], "name", (Property("cn_label", "cnLabel"), Property("level", "level", _INT)))),
    ("author_of", _edge("authorOf", "Scholar", "scholar_id", "Publication", "pub_id")),
    ("affiliation", _edge("affiliatedWith", "Scholar", "scholar_id", "Institution", "inst_id")),
    ("published_in", _edge("publishedIn", "Publication", "pub_id", "Venue", "venue_id")),
    ("belongs_to_field", _edge("belongsToField", "Publication", "pub_id", "Field", "field_id")),
)


def star_triples(tables: dict[str, DataFrame], mappings: tuple[tuple[str, Mapping], ...] = STAR) -> DataFrame:
    """Distinct triples of the tables that are given."""
    return union([apply_mapping(tables[name], m, name) for name, m in mappings if name in tables]).dropDuplicates()
