"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

from .quality import RULES, STOP_WORDS

_SPACE = "[ \\t\\n\\x0B\\x0C\\r]+"


def quality_sql() -> str:
    stop = ", ".join("'" + v + "'" for w in STOP_WORDS for v in dict.fromkeys((w, w.capitalize(), w.upper())))
    rules = []
    for r in RULES:
        ratio = f"coalesce({r.over}::double / nullif({r.under}, 0), 0)"
        rules += [f"{ratio} >= {r.low}"] if r.low is not None else []
        rules += [f"{ratio} <= {r.high}"] if r.high is not None else []
    return f"""
    with d as (select doc_id, coalesce(text, '') t from documents),
    w as (select doc_id, t, list_filter(string_split_regex(t, '{_SPACE}'), lambda x: x <> '') w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\x0C\\r]')) l from d),
    g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g from (select doc_id, w, unnest(range(1, len(w) - 1)) i from w where len(w) > 2)),
    r as (select doc_id, i from g qualify count(*) over (partition by doc_id, g) > 1),
    c as (select doc_id, count(distinct i + k) n from r, range(3) x(k) group by 1),
    f as (select w.doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint n_symbols,
      (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(c.n, 0)::bigint n_repeat_words, len(l) n_lines, len(list_filter(w, lambda x: x in ({stop}))) n_stop_words from w left join c using (doc_id)),
    b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from f)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {" and ".join(rules)} kept from b"""


DECONTAMINATION = """
with d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') w from documents),
b as (select item_id::varchar item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') w from benchmark),
p as (select distinct item, i pos, k, array_to_string(w[i:i + k - 1], ' ') g from (select item, w, least(10, len(w)) k, unnest(range(1, len(w) - least(10, len(w)) + 2)) i from b where len(w) > 0)),
s as (select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from d, (select distinct k from p) where len(w) >= k)),
m as (select s.doc_id, s.i, s.k, p.item, s.i - p.pos diagonal from s join p using (k, g)),
x as (select *, case when i <= max(i + k) over (partition by doc_id, item, diagonal order by i, k rows between unbounded preceding and 1 preceding) then 0 else 1 end fresh from m),
y as (select *, sum(fresh) over (partition by doc_id, item, diagonal order by i, k rows unbounded preceding) run from x),
z as (select doc_id, max(n)::bigint longest from (select doc_id, max(i + k) - min(i) n from y group by doc_id, item, diagonal, run) group by 1),
h as (select doc_id, count(distinct j) n_hit from (select doc_id, unnest(range(i, i + k)) j from m) group by 1),
t as (select doc_id, count(distinct item) n_items, string_agg(distinct item, ',' order by item) items from m group by 1)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated, coalesce(longest, 0) longest
from d left join h using (doc_id) left join t using (doc_id) left join z using (doc_id)"""

JACCARD = """
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\x0C\\r]+'), lambda x: x <> '') w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from d where len(w) > 0)),
n as (select doc_id, count(*) n from s group by 1),
e as (select a.doc_id a, b.doc_id b from s a join s b using (g) join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id where a.doc_id < b.doc_id group by a.doc_id, b.doc_id, x.n, y.n
  having 100 * count(*) >= 75 * (x.n + y.n - count(*))),
u as (select a, b from e union all select b, a from e),
r(x, y) as (select doc_id, doc_id from d union select r.x, u.b from r join u on u.a = r.y),
c as (select x doc_id, min(y) component_id from r group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, c.component_id from d left join n using (doc_id) join c using (doc_id)"""

WARC = """
with p as (select page_id, coalesce(html, '') h, coalesce(url, '') u, min(page_id) over (partition by coalesce(html, '')) f from pages),
x as (select *, sha1(encode(h)) sha, lower(regexp_extract(u, '^https?://([^/?#]*)', 1)) host, regexp_replace(regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') path,
  regexp_extract(u, '^[^?#]*[?]([^#]*)', 1) q, strftime(timestamp '2024-01-01' + to_seconds(page_id % 2147483648), '%Y%m%d%H%M%S') "timestamp" from p),
k as (select *, case when u = '' then '' else lower(array_to_string(list_reverse(string_split(regexp_replace(host, '^www[0-9]*[.]', ''), '.')), ',') || ')' || case when path = '' then '/' else path end
  || case when q = '' then '' else '?' || array_to_string(list_sort(string_split(q, '&')), '&') end) end url_key from x)
select page_id, octet_length(encode(h))::bigint payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, 1 + 5 * (i // 4)::int, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int, 1)), '') payload_digest,
  case when f = page_id then 'response' else 'revisit' end record_type, case when f <> page_id then f end refers_to,
  row_number() over (order by url_key, "timestamp", page_id) - 1 history, url_key, "timestamp" from k"""

SUFFIXES = """
with d as (select doc_id, encode(coalesce(text, '')) b, octet_length(encode(coalesce(text, ''))) n from documents),
w as (select doc_id, i, md5(b[i:i + 399]) h from (select doc_id, b, unnest(range(1, n - 398)) i from d where n >= 400)),
r as (select doc_id, i from w qualify count(*) over (partition by h) > 1),
x as (select doc_id, i, (i - lag(i) over (partition by doc_id order by i) > 400)::int apart from r),
y as (select doc_id, i, coalesce(sum(apart) over (partition by doc_id order by i), 0) run from x),
s as (select doc_id, min(i) a, max(i) + 399 z from y group by doc_id, run),
p as (select doc_id, a, z, lag(z, 1, 0) over (partition by doc_id order by a) before from s),
k as (select doc_id, string_agg(case when a > before + 1 then hex(b[before + 1:a - 1]) else '' end, '' order by a) head, max(z) last, sum(z - a + 1)::bigint n_removed, count(*)::bigint n_spans from p join d using (doc_id) group by 1)
select doc_id, n::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans,
  sha256(unhex(coalesce(head, '') || case when coalesce(last, 0) < n then hex(b[coalesce(last, 0) + 1:n]) else '' end)) kept_sha256 from d left join k using (doc_id)"""


MIXING = """
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint size, ('0x' || substr(md5(doc_id::varchar || ':7'), 1, 15))::bigint o from documents),
r as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) - 1 rank from d group by 1),
w as (select *, [5::double, 2::double, 1::double][1 + rank % 3] weight, [0.5::double, 0::double, -0.5::double][1 + rank % 3] slope from r),
x as (select *, (sum(source_size) over ())::double total, coalesce(sum(source_size) over c, 0)::double * 3 before, sum(weight) over () - coalesce(sum(weight) over c, 0) weights from w
  window c as (order by source_size / weight, rank rows between unbounded preceding and 1 preceding)),
z as (select *, (total - before) / weights lev, weight * ((total - before) / weights) >= 3.0::double * source_size is_full from x),
f as (select (select lev from z where not is_full order by source_size / weight, rank limit 1) final),
t as (select source, source_size, slope, case when final is null then 3.0::double * source_size else least(3.0::double * source_size, weight * final) end target from z, f),
m as (select d.doc_id, size, source_size, slope, target, round(target)::bigint want, coalesce(sum(size) over (partition by d.source order by o, d.doc_id rows between unbounded preceding and 1 preceding), 0)::bigint place from d join t on d.source is not distinct from t.source),
n as (select *, case when source_size > 0 then floor(want::double / source_size)::bigint else 0 end passes from m),
c as (select *, (passes * size + greatest(0, least(size, want - passes * source_size - place)))::bigint taken from n),
e as (select *, case when size > 0 then floor(taken::double / size + 0.5)::bigint else 0 end copies, 1 + slope a from c)
select doc_id, size, source_size, target, taken,
  case when taken > 0 then list_transform([case when want > 0 then least(1.0::double, place::double / want) else 0.0::double end], lambda u: 2 * u / (a + sqrt(greatest(a * a - 4 * slope * u, 0))))[1] end "position",
  list_transform(list_transform(range(0, copies), lambda k: case when want > 0 then least(1.0::double, (place + k * source_size)::double / want) else 0.0::double end), lambda u: 2 * u / (a + sqrt(greatest(a * a - 4 * slope * u, 0)))) positions from e"""

AUDIT = f"""
with d as (select doc_id, coalesce(text, '') t, coalesce(source, '') part from documents),
w as (select *, list_filter(string_split_regex(t, '{_SPACE}'), lambda x: x <> '') w, coalesce(min(doc_id) over (partition by t) < doc_id, false) is_copy from d),
f as (select doc_id, part, {{'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(t),
  'D': regexp_matches(t, '[#$%&*|]'), 'E': is_copy}} f from w),
y as (select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels group by 1),
m as (select part, f, count(*) n, count(*) filter (where good) good, count(*) filter (where toxic) toxic from f left join y using (doc_id) group by part, f),
v as (select part, unnest([('A', f.A), ('B', f.B), ('C', f.C), ('D', f.D), ('E', f.E)]) x, f, n, good, toxic from m),
k as (select part, f, any_value(n) n, any_value(good) good, any_value(toxic) toxic, list(x[1]) filter (where x[2]) bad from v group by part, f),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) l),
o as (select a.l || b.l || c.l || d.l || e.l filter_order from l a, l b, l c, l d, l e where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
s as (select filter_order, unnest(range(1, 6))::int step from o),
x as (select part, filter_order, step, n, good, toxic, coalesce(list_contains(bad, filter_order[step]), false) fails, len(coalesce(bad, [])) n_bad,
  len(list_filter(coalesce(bad, []), lambda b: contains(filter_order[1:step - 1], b))) > 0 gone from k, s)
select part, filter_order, step, coalesce(sum(n) filter (where not fails and not gone), 0)::bigint kept, coalesce(sum(n) filter (where fails and not gone), 0)::bigint removed,
  coalesce(sum(n) filter (where fails and gone), 0)::bigint redundant, coalesce(sum(n) filter (where fails and n_bad = 1), 0)::bigint unique_fails,
  coalesce(sum(good) filter (where fails and not gone), 0)::bigint good_lost, coalesce(sum(toxic) filter (where fails and not gone), 0)::bigint toxic_lost,
  sum(coalesce(sum(n) filter (where fails and not gone), 0)) over (partition by part, filter_order[step])::bigint shapley from x group by part, filter_order, step"""

TRIE = f"""
with t as (select conv_id c, turn, md5(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) m,
  len(list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> ''))::bigint words from conversations where conv_id is not null),
o as (select c, m, words, row_number() over (partition by c order by turn nulls first, m) p, count(*) over (partition by c) n from t),
h as (select distinct c, n, c - c % 20 b, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda v, z: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)), 4294967295) % 4 h from o),
u as (select h.c, o.p d, o.m, o.words from h join o on o.c = h.b and o.p <= h.h
  union all select h.c, least(h.h, coalesce(b.n, 0)) + o.p - h.h, o.m, o.words from h join o on o.c = h.c and o.p > h.h left join h b on b.c = h.b),
k as (select c, d, words, string_agg(m, '') over (partition by c order by d) k, coalesce(string_agg(m, '') over (partition by c order by d rows between unbounded preceding and 1 preceding), '') pk from u
  union all select c, 0, 0, '', null from h),
e as (select k, sha256(string_agg(c::varchar, ',' order by c)) ends from (select c, max(d) d from k group by c) join k using (c, d) group by k),
v as (select d depth, k, any_value(pk) pk, min(c) conv_id, count(*) n_convs, any_value(words) words from k group by d, k),
n as (select v.*, (select count(*) from v w where w.pk = v.k) n_children from v),
s as (select k.k, sum((n.n_convs - 1) * n.words) saved_tokens, count(*) filter (where n.n_children = 0) n_leaves from n join k on k.c = n.conv_id and k.d <= n.depth group by k.k)
select n.conv_id, n.depth, p.conv_id parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens::bigint saved_tokens, coalesce(e.ends, sha256('')) ends_sha256
from n join s using (k) left join n p on p.k = n.pk left join e using (k)"""

NEAR_COPIES = JACCARD.replace(">= 75 *", ">= 85 *").replace("c.component_id from d", "c.component_id, c.component_id = d.doc_id kept from d")

ORACLE_SQL = {"op13_minhash_dedup": NEAR_COPIES, "op11_prefix_trie": TRIE, "op12_filter_audit": AUDIT, "op3_suffix_dedup": SUFFIXES, "op7_source_mixing": MIXING, "op1_jaccard_join": JACCARD, "op2_quality_rules": quality_sql(), "op5_warc_index": WARC, "op9_decontamination": DECONTAMINATION}
