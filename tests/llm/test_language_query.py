import numpy as np
from pagemill.llm import language as L
from pagemill.llm.queries import QUERIES


def test_the_query_classifies_documents_and_pages(spark, sf):
    docs, pages = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/pages.parquet")
    rows = QUERIES["op8_language_evidence"](spark, sf).collect()
    of_docs = {r.doc_id: (r.lang, r.kept) for r in rows if r.page_id is None}
    of_pages = {r.page_id: (r.lang, r.kept) for r in rows if r.doc_id is None}
    assert len(rows) == len(of_docs) + len(of_pages) == docs.count() + pages.count()
    assert of_docs == {r.doc_id: (r.lang, r.kept) for r in L.identify_documents(docs).collect()}
    said = {r.page_id: r.declared for r in L.page_evidence(pages).collect()}
    assert of_pages.keys() == said.keys() and np.mean([of_pages[k][0] == v for k, v in said.items()]) > 0.7
