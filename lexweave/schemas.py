"""Schemas of the tables that the pipelines read and write."""

from __future__ import annotations

DOCUMENT = "doc_id long, title string, body string"
MATRIX = "term_id int, pmid int, weight double"
SCORE = "src_pmid int, rel_pmid int, score double"
NEIGHBOUR = "src_pmid int, rel_pmid int, score int, link_name string"
ABSTRACT = "pmid int, abs string"
HEADING = "pmid int, mesh string, major string"
SYNONYM = "mesh string, fuzzy string"
QUALIFIER = "pmid int, descriptor_name string, qualifier_name string, qualifier_name_major_yn string"
POSTING = "mesh string, pmid int, cnt int, major boolean"
VOCABULARY = "term string, term_id int"
ARTICLE = "pmid int, articleTitle string, abstractText string"
DICTIONARY = "cui string, str string"
ANNOTATION = "pmid int, start string, end string, word string, type string, id string"
CITATION = "PMID int, ArticleTitle string, AbstractText string, DescriptorName array<string>"
FACTORS = "doc_id long, vec array<double>"
