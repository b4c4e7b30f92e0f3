"""Column layouts of the dump and of the tables made from it.

Element names, column names and their order are fixed values of the formats.
"""

from __future__ import annotations

REVISION_XML = (
    "id BIGINT, parentid BIGINT, timestamp STRING, "
    "contributor STRUCT<username: STRING, id: BIGINT, ip: STRING>, "
    "minor STRING, comment STRING, model STRING, format STRING, text STRING, sha1 STRING"
)
# A struct type inside a struct needs colons, a top-level schema does not.
REVISION_STRUCT = (
    "STRUCT<id: BIGINT, parentid: BIGINT, timestamp: STRING, "
    "contributor: STRUCT<username: STRING, id: BIGINT, ip: STRING>, "
    "minor: STRING, comment: STRING, model: STRING, format: STRING, text: STRING, sha1: STRING>"
)
PAGE_HEADER_XML = "title STRING, ns INT, id BIGINT, restrictions STRING, redirect STRUCT<_title: STRING>"
CORRUPT = "_corrupt"
PAGE_XML = f"{PAGE_HEADER_XML}, revision ARRAY<{REVISION_STRUCT}>, {CORRUPT} STRING"
HEADER_XML = f"{PAGE_HEADER_XML}, {CORRUPT} STRING"  # pages without their revisions
SITEINFO_XML = "namespaces STRUCT<namespace: ARRAY<STRUCT<_VALUE: STRING, _key: INT>>>"

# Flat layout shared by every operator: one row per revision. (page_seq, rev_seq) is the document order;
# page_seq is any orderable value, rev_seq a BIGINT that is unique within its page.
REVISION_COLUMNS = [
    "page_id", "page_seq", "rev_seq", "title", "rev_id", "parent_id", "rev_timestamp", "contributor_id",
    "username", "ip", "minor", "comment", "model", "format", "sha1", "text",
]

PAGE_TABLE = (
    "page_id BIGINT, page_namespace INT, page_title STRING, page_restrictions STRING, page_is_redirect INT, "
    "page_is_new INT, page_random DOUBLE, page_touched STRING, page_links_updated STRING, page_latest BIGINT, "
    "page_len BIGINT, page_content_model STRING, page_lang STRING"
)
REVISION_TABLE = (
    "rev_id BIGINT, rev_page BIGINT, rev_text_id BIGINT, rev_comment STRING, rev_user BIGINT, rev_user_text STRING, "
    "rev_timestamp STRING, rev_minor_edit INT, rev_deleted INT, rev_len BIGINT, rev_parent_id BIGINT, "
    "rev_sha1 STRING, rev_content_model STRING, rev_content_format STRING"
)
TEXT_TABLE = "old_id BIGINT, old_text STRING, old_flags STRING"
RECENTCHANGES_TABLE = (
    "rc_id BIGINT, rc_timestamp STRING, rc_user BIGINT, rc_user_text STRING, rc_title STRING, rc_minor INT, "
    "rc_bot INT, rc_cur_id BIGINT, rc_this_oldid BIGINT, rc_last_oldid BIGINT, rc_type INT, rc_source STRING, "
    "rc_patrolled INT, rc_ip STRING, rc_old_len BIGINT, rc_new_len BIGINT, rc_deleted INT, rc_logid BIGINT"
)
TABLES = {
    "page": PAGE_TABLE,
    "revision": REVISION_TABLE,
    "text": TEXT_TABLE,
    "recentchanges": RECENTCHANGES_TABLE,
}
