"""Every query of the reference library, by part."""
from granary.plans import corpus_queries, geo_queries, linkage_queries, place_queries, record_queries, relational_queries, scalar_queries, text_queries, census_queries, evaluation_queries, resolution_queries, coordinate_queries, recipe_queries, gazetteer_queries, source_queries  # noqa: F401
