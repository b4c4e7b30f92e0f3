"""The same results in plain SQL, written from the rules and not from the Spark code."""

from __future__ import annotations

from .seeds import BLOCK_TAG, DOCS_SQL, NSLIST_SQL, REVS_SQL

VIEWS = {
    "revs": REVS_SQL.format(events="events"),
    "docs": DOCS_SQL.format(documents="documents"),
    "nslist": NSLIST_SQL,
    "facts": """
        select *, coalesce(md5(nullif(text, '')), '') as digest,
          case when text <> '' then strlen(text) end as text_bytes,
          case when text <> '' then cast(upper(substr(text, 1, 9)) = '#REDIRECT' and contains(text, '[[') as int) end
            as text_redirect
        from revs""",
    "textids": """
        select *, first_value(rev_id) over (partition by page_id, digest order by rev_seq) as rev_text_id from facts""",
    "walk": """
        select *, max(rev_timestamp) over (partition by page_id order by rev_seq
          rows between unbounded preceding and 1 preceding) as prev from facts""",
    "rollup": """
        select page_id, arg_max(rev_id, rev_timestamp) as latest_id, max(rev_timestamp) as touched,
          cast(coalesce(arg_max(text_bytes, rev_timestamp) filter (where text_bytes is not null), 0) as bigint)
            as text_len,
          cast(coalesce(arg_max(text_redirect, rev_timestamp) filter (where text_bytes is not null), 0) as int)
            as is_redirect
        from walk where prev is null or rev_timestamp > prev group by page_id""",
    "ntexts": "select page_id, count(distinct digest) as n_texts from facts group by page_id",
    "revpages": """
        select page_id, min(page_seq) as page_seq, min(title) as title from revs group by page_id""",
    "titled": """
        select p.page_id, p.page_seq, p.title, replace(p.title, ' ', '_') as full_title,
          cast(coalesce(n.ns_id, 0) as int) as page_namespace,
          case when n.ns_id is null then replace(p.title, ' ', '_')
               else substr(replace(p.title, ' ', '_'), length(n.ns_name) + 2) end as page_title
        from {pages} p left join nslist n
          on n.ns_name is not null and starts_with(replace(p.title, ' ', '_'), replace(n.ns_name, ' ', '_') || ':')""",
    "page": """
        select t.page_id, t.page_namespace, t.page_title, '' as page_restrictions, r.is_redirect as page_is_redirect,
          case when n.n_texts = 1 then 1 else 0 end as page_is_new,
          cast(('0x' || substr(md5(cast(t.page_id as varchar)), 1, 13)) as bigint) / 4503599627370496.0::double
            as page_random,
          regexp_replace(r.touched, '[^0-9]', '', 'g') as page_touched, cast(null as varchar) as page_links_updated,
          r.latest_id as page_latest, r.text_len as page_len, cast(null as varchar) as page_content_model,
          'en' as page_lang
        from titled t join rollup r using (page_id) join ntexts n using (page_id)""",
    "revision": """
        select rev_id, page_id as rev_page, rev_text_id, coalesce(comment, '') as rev_comment,
          cast(coalesce(contributor_id, 0) as bigint) as rev_user, coalesce(ip, username, '') as rev_user_text,
          regexp_replace(rev_timestamp, '[^0-9]', '', 'g') as rev_timestamp, cast(minor as int) as rev_minor_edit,
          0 as rev_deleted, cast(null as bigint) as rev_len, cast(coalesce(parent_id, 0) as bigint) as rev_parent_id,
          sha1 as rev_sha1, model as rev_content_model, format as rev_content_format
        from textids""",
    "texttable": """
        select rev_id as old_id, coalesce(text, '') as old_text, '' as old_flags from textids
        where rev_id = rev_text_id""",
    "current": """
        select r.page_id, t.page_namespace, t.title, max_by(rev_id, rev_seq) as rev_id,
          max_by(parent_id, rev_seq) filter (where parent_id is not null) as parent_id,
          max_by(rev_timestamp, rev_seq) filter (where rev_timestamp is not null) as rev_timestamp,
          max_by(sha1, rev_seq) as sha1, max_by(model, rev_seq) as model, max_by(format, rev_seq) as format,
          max_by(text, rev_seq) filter (where text is not null) as text
        from revs r join titled t using (page_id) group by r.page_id, t.page_namespace, t.title""",
    "cats": r"""
        select page_id, page_seq, text, regexp_extract_all(text, '\[\[Category:([a-zA-Z0-9_\s\-]+)\]\]', 1) as names
        from docs""",
    "ordinals": "select page_id, row_number() over (order by page_seq) - 1 as ordinal from docs",
    "corpus": """
        select distinct category, ordinal, article from (
          select unnest(names) as category, ordinal, text as article from cats join ordinals using (page_id))""",
    "pageno": "select page_id, row_number() over (order by page_seq) as new_id from revpages",
    "revno": "select rev_id, row_number() over (order by page_seq, rev_seq) as new_id from revs",
    "firsttitle": """
        select *, row_number() over (partition by full_title order by page_seq) as nth from titled""",
    "lines": f"""
        select page_id, pos, case when page_id % 2 = 0 and pos % 11 = 3 then '<{BLOCK_TAG}>'
          when page_id % 2 = 0 and pos % 11 = 6 then '</{BLOCK_TAG}>' else line end as line
        from (select page_id, unnest(string_split(text, chr(10))) as line,
                generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from docs)""",
    "marks": f"""
        select *, last_value(case when trim(line) = '<{BLOCK_TAG}>' then 1 when trim(line) = '</{BLOCK_TAG}>' then 0 end
          ignore nulls) over (partition by page_id order by pos rows between unbounded preceding and 1 preceding)
          as inside from lines""",
    # dumps written from the views
    "scanned": """
        select page_id, cast(case when starts_with(title, 'Talk:') then 1 when starts_with(title, 'User talk:') then 3
            else 0 end as int) as page_ns, title, redirect_title, 1 as n_revisions, page_id as rev_id,
          'seed' as username, sha1(text) as sha1, text from docs""",
    "keptpages": "select * from firsttitle where nth = 1",
    "keptfacts": "select f.* from textids f join keptpages k using (page_id)",
    "keptpageno": "select page_id, row_number() over (order by page_seq) as new_id from keptpages",
    "keptrevno": "select rev_id, row_number() over (order by page_seq, rev_seq) as new_id from keptfacts",
    "keptpage": """
        select p.* from page p join keptpages using (page_id)""",
    "newpage": """
        select n.new_id as page_id, page_namespace, page_title, page_restrictions, page_is_redirect, page_is_new,
          page_random, page_touched, page_links_updated, coalesce(r.new_id, 0) as page_latest, page_len,
          page_content_model, page_lang
        from page p join keptpageno n using (page_id) left join keptrevno r on r.rev_id = p.page_latest""",
    "keptrevision": "select * from revision where rev_page in (select page_id from keptpages)",
    "newrevision": """
        select r.new_id as rev_id, n.new_id as rev_page, t.new_id as rev_text_id, rev_comment, rev_user, rev_user_text,
          rev_timestamp, rev_minor_edit, rev_deleted, rev_len, cast(coalesce(q.new_id, 0) as bigint) as rev_parent_id,
          rev_sha1, rev_content_model, rev_content_format
        from keptrevision v join keptrevno r on r.rev_id = v.rev_id join keptpageno n on n.page_id = v.rev_page
          join keptrevno t on t.rev_id = v.rev_text_id left join keptrevno q on q.rev_id = v.rev_parent_id""",
    "kepttext": "select x.* from texttable x join keptfacts f on f.rev_id = x.old_id",
    "newtext": "select n.new_id as old_id, old_text, old_flags from kepttext x join keptrevno n on n.rev_id = x.old_id",
    # history tables of the docs view, where a page has one revision whose id is the page's
    "doc_page": """
        select page_id, page_namespace, page_title, '' as page_restrictions,
          cast(upper(substr(text, 1, 9)) = '#REDIRECT' and contains(text, '[[') as int) as page_is_redirect,
          1 as page_is_new, 0.0::double as page_random, '20240101000000' as page_touched,
          cast(null as varchar) as page_links_updated, page_id as page_latest, strlen(text) as page_len,
          cast(null as varchar) as page_content_model, 'en' as page_lang, text
        from firsttitle join docs using (page_id) where nth = 1""",
    "doc_revision": """
        select page_id as rev_id, page_id as rev_page, page_id as rev_text_id, '' as rev_comment, 0 as rev_user,
          'seed' as rev_user_text, page_touched as rev_timestamp, 0 as rev_minor_edit, 0 as rev_deleted,
          cast(null as bigint) as rev_len, 0 as rev_parent_id, sha1(text) as rev_sha1,
          'wikitext' as rev_content_model, 'text/x-wiki' as rev_content_format, page_namespace
        from doc_page""",
    "doc_text": "select page_id as old_id, text as old_text, '' as old_flags, page_namespace from doc_page",
    "shown": """
        select page_id, page_ns as page_namespace, title, page_id as rev_id, text, sha1 from scanned
        where redirect_title is null""",
    "doctext": "select page_id as old_id, text as old_text, '' as old_flags from docs",
    "doctsv": r"""
        select old_id, row_number() over (order by old_id) - 1 as idx, count(*) over () as n,
          replace(replace(replace(replace(old_text, '\', '\\'), chr(13), '\r'), chr(10), '\n'), chr(9), '\t') as value
        from doctext""",
}
# Views that a view reads, in order of need.
NEEDS = {
    "facts": ["revs"], "textids": ["facts"], "walk": ["facts"], "rollup": ["walk"], "ntexts": ["facts"],
    "revpages": ["revs"], "page": ["titled", "rollup", "ntexts"], "revision": ["textids"], "texttable": ["textids"],
    "current": ["revs", "titled"], "cats": ["docs"], "ordinals": ["docs"], "corpus": ["cats", "ordinals"],
    "pageno": ["revpages"], "revno": ["revs"], "firsttitle": ["titled"], "lines": ["docs"], "marks": ["lines"],
    "keptpage": ["page", "keptpages"], "newpage": ["page", "keptpageno", "keptrevno"],
    "keptrevision": ["revision", "keptpages"], "newrevision": ["keptrevision", "keptrevno", "keptpageno"],
    "kepttext": ["texttable", "keptfacts"], "newtext": ["kepttext", "keptrevno"],
    "doc_page": ["firsttitle", "docs"], "doc_revision": ["doc_page"], "doc_text": ["doc_page"], "shown": ["scanned"],
    "scanned": ["docs"], "keptpages": ["firsttitle"], "keptfacts": ["textids", "keptpages"],
    "keptpageno": ["keptpages"], "keptrevno": ["keptfacts"], "doctext": ["docs"], "doctsv": ["doctext"],
}


def _with(views: str, select: str, pages: str = "revpages") -> str:
    """Prefix ``select`` with the views it needs; ``pages`` is the source of the titled pages."""
    order: list[str] = []

    def need(name: str) -> None:
        below = ["nslist", pages] if name == "titled" else NEEDS.get(name, [])
        for other in below:
            need(other)
        if name not in order:
            order.append(name)

    for view in views.split():
        need(view)
    body = ",\n".join(f"{v} as ({VIEWS[v].format(pages=pages) if v == 'titled' else VIEWS[v]})" for v in order)
    return f"with {body}\n{select}"


def _docs_titled(view: str, select: str) -> str:
    return _with(view, select, pages="docs")


_COUNTS = """
select 'page' as table_name, cast({page} as bigint) as n_rows union all select 'revision', {revision}
union all select 'text', {text} union all select 'recentchanges', 0"""

# Columns of the tables in their order; page_random, a double, is compared by build_page.
_PAGE = """page_id, page_namespace, page_title, page_restrictions, page_is_redirect, page_is_new, page_touched,
  page_links_updated, page_latest, page_len, page_content_model, page_lang"""
_REVISION = """rev_id, rev_page, rev_text_id, rev_comment, rev_user, rev_user_text, rev_timestamp, rev_minor_edit,
  rev_deleted, rev_len, rev_parent_id, rev_sha1, rev_content_model, rev_content_format"""
_TEXT = "old_id, old_text, old_flags"


def _digests(*tables: tuple[str, str, str]) -> str:
    """One row for each row of (name, columns with the key first, source)."""
    return " union all ".join(
        f"select '{name}' as table_name, cast({columns.split(',')[0]} as bigint) as id, md5(concat_ws('|', {columns})) as digest from {source}"
        for name, columns, source in tables)


_KEPT = _digests(("page", _PAGE, "keptpage"), ("revision", _REVISION, "keptrevision"), ("text", _TEXT, "kepttext"))
_NEW = _digests(("page", _PAGE, "newpage"), ("revision", _REVISION, "newrevision"), ("text", _TEXT, "newtext"))
_DOC_TABLES = (("page", _PAGE, "doc_page"), ("revision", _REVISION, "doc_revision"), ("text", _TEXT, "doc_text"))
_CURRENT = _digests(
    ("page", "page_id, page_namespace, title, 0, 1, rev_id, length(text), 'wikitext'", "shown"),
    ("revision", "rev_id, page_id, page_id, 0, 'importer', '20240101000000', 0, 0, length(text), 0, sha1", "shown"),
    ("text", "page_id, text", "shown"),
    ("recentchanges", "page_id, '20240101000000', 0, 'importer', title, 0, 0, page_id, page_id, 0, 0, 'mw.new', 0, "
                      "'127.0.0.1', 0, length(text), 0, 0", "shown"),
)

_FLAT = "parent_id, rev_timestamp, contributor_id, username, ip, minor, comment, model, format, sha1"

ORACLES: dict[str, str] = {
    # sources
    "scan_dump": _with("scanned", "select * from scanned"),
    "scan_dump_namespaces": _with("scanned", "select * from scanned where page_ns in (0, 3)"),
    "scan_cut_pages": _with("docs", """
        select page_id, title, case when page_id is null or title is null then 'nameless'
          when page_id % 10 = 3 then 'cut' else 'kept' end as state from docs"""),
    "scan_dump_bz2": _with("scanned", "select * from scanned"),
    "explode_revisions": _with("revs", f"""
        select page_id, row_number() over (partition by page_id order by rev_seq) - 1 as rev_pos, title, rev_id,
          {_FLAT}, text from revs"""),
    "scan_history": _with("facts", f"""
        select page_id, title, rev_id, {_FLAT}, digest, text_bytes, text_redirect from facts"""),
    "scan_namespaces": _with("nslist", "select ns_pos, ns_id, ns_name from nslist"),
    "drop_tag_blocks": _with("marks", f"""
        select page_id, cast(row_number() over (partition by page_id order by pos) - 1 as int) as pos, line from marks
        where coalesce(inside, 0) = 0 and trim(line) <> '<{BLOCK_TAG}>'"""),
    "quarantine_malformed": _with("revpages", """
        select page_id, case when page_id % 10 = 3 then 'bad' else 'good' end as status from revpages"""),
    # sinks
    "write_tables": _with("rollup textids texttable", """
        select r.page_id, latest_id as rev_id, t.rev_text_id as text_id, o.old_text as article
        from rollup r join textids t on t.rev_id = r.latest_id join texttable o on o.old_id = t.rev_text_id"""),
    "write_tsv": _with("doctsv", r"select concat(old_id, chr(9), value, chr(9)) as line from doctsv"),
    "write_mysql_insert": _with("doctsv", r"""
        select concat(case when idx % 256 = 0 then 'INSERT INTO `text` VALUES ' else ',' end, '(', old_id, ',''',
          replace(replace(value, '''', '\'''), '"', '\"'), ''','''')',
          case when idx % 256 = 255 or idx = n - 1 then ';' else '' end) as line from doctsv"""),
    "write_mysql_revision": _with("revision", r"""
        select concat(case when idx % 256 = 0 then 'INSERT INTO `revision` VALUES ' else ',' end, '(', rev_id, ',', rev_page,
          ',', rev_text_id, ',''', rev_comment, ''',', rev_user, ',''', rev_user_text, ''',''', rev_timestamp, ''',',
          rev_minor_edit, ',', rev_deleted, ',NULL,', rev_parent_id, ',''', rev_sha1, ''',''', rev_content_model, ''',''',
          rev_content_format, ''')', case when idx % 256 = 255 or idx = n - 1 then ';' else '' end) as line
        from (select *, row_number() over (order by rev_id) - 1 as idx, count(*) over () as n from revision)"""),
    "write_tsv_page": _with("page", r"""
        select cast(page_id as varchar) as page_id, cast(page_namespace as varchar) as page_namespace, page_title,
          page_restrictions, cast(page_is_redirect as varchar) as page_is_redirect,
          cast(page_is_new as varchar) as page_is_new, page_random, page_touched, '\N' as page_links_updated,
          cast(page_latest as varchar) as page_latest, cast(page_len as varchar) as page_len,
          '\N' as page_content_model, page_lang from page"""),
    "write_pg_copy": _with("textids", r"""
        select concat_ws(chr(9), rev_id, page_id, rev_text_id, coalesce(comment, ''), coalesce(contributor_id, 0),
          coalesce(ip, username, ''), rev_timestamp, cast(minor as int), 0, '\N', coalesce(parent_id, 0), sha1, model,
          format) as line from textids"""),
    "write_corpus": _with("corpus", "select category, ordinal, article from corpus"),
    "create_tables": _with("revs texttable", _COUNTS.format(
        page="(select count(distinct page_id) from revs)", revision="(select count(*) from revs)",
        text="(select count(*) from texttable)")),
    "truncate_tables": _COUNTS.format(page="0", revision="0", text="0"),
    "skip_text": _with("keptpages keptfacts", """
        select 'page' as table_name, count(*) as n_rows from keptpages
        union all select 'revision', count(*) from keptfacts"""),
    # tables
    "build_page": _with("page", "select * from page"),
    "build_revision": _with("revision", "select * from revision"),
    "build_text": _with("texttable", "select * from texttable"),
    "build_page_current": _with("current", """
        select page_id, page_namespace, title as page_title, 0 as page_is_redirect, 1 as page_is_new,
          cast(('0x' || substr(md5(cast(page_id as varchar)), 1, 13)) as bigint) / 4503599627370496.0::double
            as page_random,
          rev_id as page_latest, cast(length(text) as bigint) as page_len, 'wikitext' as page_content_model
        from current"""),
    "build_revision_current": _with("current", """
        select rev_id, page_id as rev_page, page_id as rev_text_id, cast(0 as bigint) as rev_user,
          'importer' as rev_user_text, regexp_replace(rev_timestamp, '[^0-9]', '', 'g') as rev_timestamp,
          0 as rev_minor_edit, 0 as rev_deleted, cast(length(text) as bigint) as rev_len,
          cast(0 as bigint) as rev_parent_id, sha1 as rev_sha1 from current"""),
    "build_text_current": _with("current", "select page_id as old_id, text as old_text from current"),
    "build_recentchanges": _with("current", """
        select page_id as rc_id, regexp_replace(rev_timestamp, '[^0-9]', '', 'g') as rc_timestamp,
          cast(0 as bigint) as rc_user, 'importer' as rc_user_text, title as rc_title, 0 as rc_minor, 0 as rc_bot,
          page_id as rc_cur_id, page_id as rc_this_oldid, cast(0 as bigint) as rc_last_oldid, 0 as rc_type,
          'mw.new' as rc_source, 0 as rc_patrolled, '127.0.0.1' as rc_ip, cast(0 as bigint) as rc_old_len,
          cast(length(text) as bigint) as rc_new_len, 0 as rc_deleted, cast(0 as bigint) as rc_logid from current"""),
    "article_record": _with("cats", """
        select page_id, text as article, array_to_string(names, '|') as categories from cats"""),
    # filters
    "filter_main_ns": _docs_titled("titled", "select page_id, page_title from titled where page_namespace = 0"),
    "filter_namespaces": _docs_titled("titled", """
        select page_id, page_namespace, page_title from titled where page_namespace in (0, 3)"""),
    "drop_redirects": _with("docs", "select page_id, title, text from docs where redirect_title is null"),
    "is_redirect": _with("revs", """
        select rev_id, upper(substr(text, 1, 9)) = '#REDIRECT' and contains(text, '[[') as is_redirect from revs"""),
    # scalar functions
    "normalize_title": _with("docs", "select page_id, replace(title, ' ', '_') as full_title from docs"),
    "timestamp_digits": _with("revs", """
        select rev_id, regexp_replace(rev_timestamp, '[^0-9]', '', 'g') as rev_timestamp from revs"""),
    "user_text": _with("revs", """
        select rev_id, cast(coalesce(contributor_id, 0) as bigint) as rev_user,
          coalesce(ip, username, '') as rev_user_text from revs"""),
    "empty_to_null": _with("revs", """
        select rev_id, nullif(coalesce(comment, ''), '') as comment, coalesce(comment, '') as written_comment
        from revs"""),
    "text_length": _with("docs", """
        select page_id, cast(strlen(text) as bigint) as n_bytes, cast(length(text) as bigint) as n_chars from docs"""),
    "text_digest": _with("revs", "select rev_id, coalesce(md5(nullif(text, '')), '') as digest from revs"),
    "extract_categories": _with("cats", """
        select page_id, cast(generate_subscripts(names, 1) - 1 as int) as pos, unnest(names) as category from cats"""),
    "sanitize_text": _with("docs", """
        select page_id, text || title as clean, text || '??' || title as repaired from docs"""),
    "escape_value": _with("docs", r"""
        select page_id, value || '\t\\''"\r' as plain,
          replace(replace(value, '''', '\'''), '"', '\"') || '\t\\\''\"\r' as quoted
        from (select page_id, replace(replace(text, '\', '\\'), chr(10), '\n') as value from docs)"""),
    "compress_text": _with("doctext", """
        select old_id, case when strlen(old_text) >= 512 and old_id % 3 <> 0 then 'gzip' else '' end as old_flags,
          cast(strlen(old_text) as bigint) as n_bytes, md5(old_text) as digest from doctext"""),
    # joins
    "resolve_namespace": _docs_titled("titled", "select page_id, full_title, page_namespace, page_title from titled"),
    "renumber": _with("pageno revno", """
        select 'page' as kind, page_id as id, new_id from pageno
        union all select 'revision', rev_id, new_id from revno"""),
    "remap_ids": _with("facts pageno revno", """
        select p.new_id as page_id, r.new_id as rev_id, cast(coalesce(q.new_id, 0) as bigint) as parent_id,
          f.rev_timestamp, f.digest
        from facts f join pageno p using (page_id) join revno r on r.rev_id = f.rev_id
          left join revno q on q.rev_id = f.parent_id"""),
    # aggregates and windows
    "conversion_counts": _with("facts textids", """
        select 'pages' as item, count(distinct page_id) as n from facts
        union all select 'revisions', count(*) from facts
        union all select 'texts', count(*) from textids where rev_id = rev_text_id"""),
    "page_rollup": _with("rollup ntexts", """
        select r.*, n_texts, case when n_texts = 1 then 1 else 0 end as is_new
        from rollup r join ntexts using (page_id)"""),
    "count_main_ns": _docs_titled("titled", "select count(*) as n_pages from titled where page_namespace = 0"),
    "category_counts": _with("corpus", "select category, count(*) as n_pages from corpus group by category"),
    "current_revision": _with("current", """
        select page_id, title, rev_id, parent_id, rev_timestamp, sha1, model, format, text from current"""),
    "dedup_titles": _docs_titled("firsttitle", "select page_id, full_title from firsttitle where nth = 1"),
    "report_duplicate_titles": _docs_titled("firsttitle", "select page_id, full_title from firsttitle where nth > 1"),
    "dedup_texts": _with("textids", "select page_id, rev_id, rev_text_id from textids"),
    "latest_revision": _with("rollup", "select * from rollup"),
    "batch_ids": _docs_titled("titled", """
        select page_id, row_number() over (order by page_id) - 1 as rank,
          cast((row_number() over (order by page_id) - 1) // 1000 as bigint) as batch
        from titled where page_namespace = 0"""),
    "order_main_ids": _docs_titled("titled", """
        select page_id, row_number() over (order by page_id) - 1 as rank from titled where page_namespace = 0"""),
    "corpus_rows": _with("corpus", "select category, ordinal, article from corpus"),
    # whole conversions
    "convert_dump": _with("keptpage keptrevision kepttext", _KEPT),
    "convert_history": _with("newpage newrevision newtext", _NEW),
    "convert_history_docs": _docs_titled("doc_page doc_revision doc_text", _digests(*_DOC_TABLES)),
    # what comes again has a known title, so nothing of it is kept
    "convert_repeated": _with("keptpage keptrevision kepttext", _KEPT),
    "convert_repeated_renumbered": _with("newpage newrevision newtext", _NEW),
    "convert_options": _docs_titled("doc_page doc_revision doc_text", _digests(
        ("page", _PAGE, "(select * replace ('2024-01-01T00:00:00Z' as page_touched) from doc_page where page_namespace in (0, 3))"),
        ("revision", _REVISION, """(select * replace ('2024-01-01T00:00:00Z' as rev_timestamp) from doc_revision
          where page_namespace in (0, 3))"""),
        ("text", _TEXT, "(select * from doc_text where page_namespace in (0, 3))"))),
    "convert_rejected": _with("firsttitle", """
        select case when page_namespace not in (0, 3) then 'namespace not chosen' when nth = 1 and part = 1 then 'kept'
          else 'repeated title or id' end as reason, page_id
        from firsttitle join (values (1), (2)) parts(part) on part = 1 or page_id % 3 < 2"""),
    "convert_current": _with("shown", _CURRENT),
    "create_corpus": _with("cats", """
        select distinct category, ordinal, article from (
          select unnest(names) as category, ordinal, text as article from cats join (
            select page_id, row_number() over (order by page_seq) - 1 as ordinal from docs
            where redirect_title is null) using (page_id))"""),
    "main_articles": _docs_titled("firsttitle cats", """
        select page_id, rank, cast(rank // 1000 as bigint) as batch, text as article, array_to_string(names, '|') as categories
        from (select page_id, row_number() over (order by page_id) - 1 as rank from firsttitle
          where nth = 1 and page_namespace = 0) join cats using (page_id)"""),
    # streaming and user code
    "stream_ingest": _with("shown", _CURRENT),
    "stream_dedup_titles": _docs_titled("firsttitle", "select page_id, full_title from firsttitle where nth = 1"),
    "map_pages": _with("docs", """
        select page_id, cast((length(text) - length(replace(text, '[[', ''))) // 2 as bigint) as n_links from docs"""),
}
ORACLES["article_lookup"] = ORACLES["write_tables"]
