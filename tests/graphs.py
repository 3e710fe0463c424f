"""Small triple graphs."""

from semlattice.plans.config import TRIPLES


def graph(spark, *triples):
    """Triples (s, p, o): literals for property names, else uris."""
    literal = {"name", "cnLabel", "year", "revenue", "employees", "region", "country", "description"}
    return spark.createDataFrame([(s, p, str(o), "literal" if p in literal else "uri", None, None) for s, p, o in triples], TRIPLES)


def company(uid, source, name="ACME", region="SH", revenue="100.0", employees="7"):
    out = [(uid, "type", "Company"), (uid, "sourcedFrom", source), (uid, "name", name), (uid, "region", region), (uid, "revenue", revenue)]
    return out + ([(uid, "employees", employees)] if employees is not None else [])
