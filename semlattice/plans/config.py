"""Ontology, namespaces and mappings: plain settings that drive the jobs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

TRIPLES = T.StructType([T.StructField(c, T.StringType()) for c in ("s", "p", "o", "o_kind", "o_datatype", "o_lang")])
TRIPLE_COLUMNS = TRIPLES.fieldNames()


@dataclass(frozen=True)
class Namespaces:
    """Subjects, predicates and classes are stored without their namespace; exports put it back."""

    resource: str = "https://example.org/resource/"
    ontology: str = "https://example.org/ontology#"


# The ontology's classes, relations (domain, range) and properties.
CLASSES = ("DataSource", "Entity", "Scholar", "Institution", "Publication", "Venue", "Field", "Funder", "Dataset", "Company", "Industry", "GenericRecord")
RELATIONS = {
    "sourcedFrom": ("Entity", "DataSource"), "authorOf": ("Scholar", "Publication"), "affiliatedWith": ("Scholar", "Institution"),
    "publishedIn": ("Publication", "Venue"), "cites": ("Publication", "Publication"), "fundedBy": ("Publication", "Funder"),
    "coAuthorWith": ("Scholar", "Scholar"), "belongsToField": ("Entity", "Field"), "belongsToIndustry": ("Company", "Industry"),
    "sameAs": ("Entity", "Entity"), "authoredBy": ("Publication", "Scholar"), "hasAuthor": ("Publication", "Scholar"), "citedBy": ("Publication", "Publication"),
}
PROPERTIES = (
    "name", "openalex_id", "year", "doi", "cited_by_count", "country", "level", "revenue", "employees", "region", "cnLabel",
    "description", "worksCount", "citedByCount", "hIndex", "publishedAt", "size", "license", "url",
)


@dataclass(frozen=True)
class Ontology:
    """Names that mappings may use; build_in names (type, name, cnLabel, sourcedFrom, sameAs) are always there."""

    classes: tuple[str, ...] = CLASSES
    relations: dict[str, tuple[str, str]] = field(default_factory=lambda: dict(RELATIONS))
    properties: tuple[str, ...] = PROPERTIES

    def with_terms(self, classes: tuple[str, ...] = (), relations: dict[str, tuple[str, str]] | None = None, properties: tuple[str, ...] = ()) -> Ontology:
        return Ontology((*self.classes, *classes), self.relations | (relations or {}), (*self.properties, *properties))


@dataclass(frozen=True)
class Property:
    """datatype: string, integer or decimal (also str, int, float)."""

    column: str
    property: str
    datatype: str = "string"
    multi_value: bool = False


@dataclass(frozen=True)
class EntityMapping:
    """Rows become entities. Templates hold {id}. multi_value: ids and labels are lists."""

    cls: str
    id_column: str
    id_template: str
    label_column: str | None = None
    properties: tuple[Property, ...] = ()
    multi_value: bool = False


@dataclass(frozen=True)
class RelationMapping:
    """Rows become edges from each subject to each object. from_value: objects are named after their value."""

    predicate: str
    subject_class: str
    subject_id_column: str
    subject_id_template: str
    object_class: str
    object_id_column: str
    object_id_template: str
    from_value: bool = False
    multi_subject: bool = False
    multi_object: bool = False


Mapping = EntityMapping | RelationMapping
