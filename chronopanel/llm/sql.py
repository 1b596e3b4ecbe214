"""DuckDB text of the corpus queries that SQL can express."""

from __future__ import annotations

import hashlib

from . import conversation_repair, lexical_search, url_filter
from .common import LOWER, UPPER
from .license_scan import COPYRIGHT_LINE, KNOWN, SPELLINGS, whole_licenses

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
with docs as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
lines as (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos from docs),
keyed as (select *, translate(trim(line, {BLANKS}), '{UPPER}', '{LOWER}') as key from lines),
common as (select key, max(doc_id) as keep from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
marked as (select k.*, c.keep is not null and k.doc_id <> c.keep as gone from keyed k left join common c using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""

CHARS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(h, {5 * i + 1}, 5))::bigint >> {15 - 5 * j} & 31)::int, 1)" for i in range(8) for j in range(4))

WARC = f"""
with p as (select page_id, url, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
f as (select html, min(page_id) as first from p group by html)
select page_id, url, strlen(html) as payload_bytes, {CHARS} as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
case when page_id <> first then first end as refers_to
from p join f using (html)
"""


def canonical(c: str) -> str:
    q = lambda s: s.replace("'", "''")
    out = f"regexp_replace(lower({c}), '{q(COPYRIGHT_LINE)}', ' ', 'g')"
    out = rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')"
    for pattern, common in SPELLINGS:
        out = f"regexp_replace({out}, '{q(pattern)}', '{common.replace('$', chr(92))}', 'g')"
    return f"trim({out})"


def canonical_text(text: str) -> str:
    """The canonical form of one text, in Python: for the digests of whole licences, which are too long to stand in SQL."""
    import regex

    out = regex.sub(r"[^\p{L}\p{N}]+", " ", regex.sub(COPYRIGHT_LINE, " ", text.lower()))
    for pattern, common in SPELLINGS:
        out = regex.sub(pattern, common.replace("$", chr(92)), out)
    return out.strip(" ")


def licenses() -> str:
    notices = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in k)) for k in KNOWN)
    whole = ", ".join(f"('{i}', '{hashlib.sha256(canonical_text(t).encode()).hexdigest()}')" for i, t in whole_licenses())
    return f"""
with known as (select digest, min(id) as license_id from (select id, sha256({canonical("t")}) as digest from (values {notices}) v(id, t) union all select * from (values {whole}) w(id, digest)) group by 1),
docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
lines as (select r, k.license_id from (select r, {canonical("line")} as c from (select r, unnest(string_split(text, chr(10))) as line from docs)) l join known k on k.digest = sha256(l.c) and l.c <> ''),
notices as (select r, string_agg(distinct license_id, ',' order by license_id) as ids, count(*) as n from lines group by r)
select doc_id, sha256(d.c) as text_digest, k.license_id, coalesce(n.ids, '') as notice_ids, coalesce(n.n, 0) as n_notice_lines
from (select *, {canonical("text")} as c from docs) d left join known k on k.digest = sha256(d.c) and d.c <> '' left join notices n using (r)
"""


KEY = r"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
QUOTE = r"(?s)^((?:[ \t]?>)+)[ \t]?(.*)$"

CHAT = rf"""
with recursive msgs as (select conv_id, turn, role, coalesce(text, '') as text from conversations),
split as (select conv_id, turn, unnest(string_split_regex(text, '\r?\n')) as raw from msgs),
lines as (select conv_id, turn, length(regexp_replace(regexp_extract(raw, '{QUOTE}', 1), '[^>]', '', 'g')) as level, case when regexp_matches(raw, '{QUOTE}') then regexp_extract(raw, '{QUOTE}', 2) else raw end as line from split),
keyed as (select conv_id, turn, level, {KEY.format(c="line")} as key from lines),
originals as (select conv_id, key, min(turn) as source from keyed where level = 0 and key <> '' group by 1, 2),
quoted as (select conv_id, turn, level, key, count(*) as n from keyed where level > 0 and key <> '' group by 1, 2, 3, 4),
votes as (select q.conv_id, q.turn, q.level, o.source, sum(q.n) as n from quoted q join originals o using (conv_id, key) where o.source < q.turn group by 1, 2, 3, 4),
parents as (select conv_id, turn, arg_max(source, {{l: -level, n: n, s: source}}) as reply_to, sum(n) as n_linked from votes group by 1, 2),
thread as (select conv_id, turn, reply_to as up, 1 as depth from parents union all select t.conv_id, t.turn, p.reply_to, t.depth + 1 from thread t join parents p on p.conv_id = t.conv_id and p.turn = t.up),
roots as (select conv_id, turn, arg_max(up, depth) as root_turn, max(depth) as depth from thread group by 1, 2),
counts as (select conv_id, turn, sum(n) as n_quoted from quoted group by 1, 2),
bodies as (select conv_id, turn, role, case when len(list_filter(string_split_regex(text, '\r?\n'), lambda x: regexp_matches(x, '{QUOTE}'))) > 0 then array_to_string(list_filter(string_split_regex(text, '\r?\n'), lambda x: not regexp_matches(x, '{QUOTE}')), chr(10)) else text end as body from msgs)
select b.conv_id, b.turn, b.role, p.reply_to, coalesce(r.root_turn, b.turn) as root_turn, cast(coalesce(r.depth, 0) as int) as depth, cast(coalesce(c.n_quoted, 0) as bigint) as n_quoted, cast(coalesce(p.n_linked, 0) as bigint) as n_linked, sha256(b.body) as body_sha256
from bodies b left join parents p using (conv_id, turn) left join roots r using (conv_id, turn) left join counts c using (conv_id, turn)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": LINE_DEDUP, "op4_license_scan": licenses(), "op6_quotation_linking": CHAT, "op8_warc": WARC, "op11_lexical_search": lexical_search.SQL, "op12_conversation_repair": conversation_repair._sql(), "op13_url_filter": url_filter.SQL}
