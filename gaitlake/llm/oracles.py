"""DuckDB equivalents of the corpus queries that SQL can express in full."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"'[^\x20\x09-\x0D]+'"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

NEAR_DUPLICATES = f"""
with recursive w as (select doc_id, regexp_extract_all({LOWER}, {SPACED}) w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w)-2), lambda k: array_to_string(w[k:k+3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from w),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
e as (select a, b from l union all select b, a from l),
r(doc_id, reached) as (select doc_id, doc_id from documents union select r.doc_id, e.b from r join e on e.a = r.reached)
select d.doc_id, coalesce(n.n, 0) n_shingles, c.component_id, d.doc_id = c.component_id kept
from documents d left join n using (doc_id) join (select doc_id, min(reached) component_id from r group by doc_id) c using (doc_id)
"""

DECONTAMINATION = f"""
with i as (select cast(item_id as varchar) id, regexp_extract_all({LOWER}, {ALNUM}) w from benchmark),
j as (select id, w, least(10, len(w)) n from i where len(w) > 0),
k as (select id, w, n, unnest(range(1, len(w)-n+2)) p0 from j),
win as (select distinct id, n, w[p0:p0+n-1] win from k),
d as (select doc_id, regexp_extract_all({LOWER}, {ALNUM}) w from documents),
lens as (select distinct n from win),
pos as (select doc_id, w, n, unnest(range(1, len(w)-n+2)) p0 from d, lens where len(w) >= n),
hit as (select doc_id, p0, p.n, id from (select doc_id, p0, n, w[p0:p0+n-1] win from pos) p join win using (n, win)),
words as (select doc_id, count(distinct word) n_hit from (select doc_id, unnest(range(p0, p0+n)) word from hit) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(id, ',' order by id) ids from (select distinct doc_id, id from hit) group by doc_id)
select doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""

QUALITY = rf"""
with w as (select doc_id, coalesce(text, '') text, regexp_extract_all(coalesce(text, ''), {SPACED}) w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from documents),
a as (select doc_id, unnest(range(1, len(w)-6)) p0, w from w where len(w) >= 8),
v as (select doc_id, p0, w[p0:p0+7] win from a),
again as (select doc_id, unnest(list(p0)) p0 from v group by doc_id, win having count(*) > 1),
rep as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(p0, p0+8)) p from again) group by doc_id),
m as (select doc_id, text, len(w) n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) word_chars, cast(length(text)-length(translate(text, '#*$%&|<>', '')) as bigint) n_symbols,
len(l) n_lines, len(l)-len(list_distinct(l)) n_dup_lines, coalesce(n, 0) n_repeat_words from w left join rep using (doc_id)),
b as (select *, n_words < 20 or 100*n_repeat_words > 30*n_words base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not (base_failed or n_symbols > n_words or 2*n_dup_lines > n_lines
or length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3*length(regexp_replace(text, '[^a-z]', '', 'g')) or 3*length(regexp_replace(text, '[^\p{{L}}\p{{M}}\p{{N}}]', '', 'g')) < word_chars
or 20*(length(text)-length(replace(text, chr(65533), ''))) > word_chars) kept from b
"""

REPEATS = """
with d as (select row_number() over () r, doc_id, hex(encode(coalesce(text, ''))) x from documents),
c as (select r, unnest(range(0, len(x) // 2 - 199, 500)) c, x from d where len(x) >= 400),
k as (select r, c, substr(x, 2 * c + 1, 1398) y from c),
w as (select r, c, unnest(range(0, least(500, len(y) // 2 - 199))) p, y from k),
v as (select r, c + p p, md5_number(substr(y, 2 * p + 1, 400)) h from w),
again as (select h from v group by h having count(*) > 1),
s as (select r, p, coalesce(p - lag(p) over (partition by r order by p) > 200, true) fresh from v semi join again using (h)),
g as (select r, p, sum(fresh::int) over (partition by r order by p) k from s),
spans as (select r, k, min(p) a, max(p) + 200 b from g group by r, k),
gaps as (select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) c from spans),
cut as (select r, count(*) n, sum(b - a) gone, max(b) last, string_agg(substr(x, 2 * c + 1, 2 * (a - c)), '' order by a) kept from gaps join d using (r) group by r)
select doc_id, cast(len(x) // 2 as bigint) n_bytes, cast(coalesce(gone, 0) as bigint) n_removed, coalesce(n, 0) n_spans,
sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) kept_sha256 from d left join cut using (r)
"""

_ASSIGN = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = ((_ASSIGN, 2), ("AKIA[A-Z0-9]+", 0), ("[0-9a-f]+", 0), (r"\b(?:gh[oprsu]_|glpat-|xox[abprs]-|sk_live_|sk-|AIza)[A-Za-z0-9_-]+", 0), ("[A-Za-z0-9+/_=-]+", 0))
_HITS = " union all ".join(f"select r, source, lang, {i} kind, regexp_extract_all(text, '{p}', 0) hit, regexp_extract_all(text, '{p}', {g}) val, string_split_regex(text, '{p}') gaps from d" for i, (p, g) in enumerate(_KINDS))

SECRETS = f"""
with d as (select row_number() over () r, doc_id, source, lang, coalesce(text, '') text from documents),
h as ({_HITS}),
k as (select r, source, lang, kind, unnest(list_zip(hit, val, gaps[1:len(hit)])) x, generate_subscripts(hit, 1) k from h where len(hit) > 0),
e as (select r, source, lang, kind, x[2] val, length(x[1]) n, sum(length(x[1]) + length(x[3])) over (partition by r, kind order by k) e from k),
f as (select r, source, lang, kind, val, cast(e - n as bigint) a, cast(e as bigint) b from e where length(val) >= [6, 20, 24, 20, 32][kind + 1]
and (kind < 4 or (regexp_matches(val, '[0-9]') and regexp_matches(val, '[A-Z]') and regexp_matches(val, '[a-z]')))),
o as (select val, count(distinct source) + max(case when source is null then 1 else 0 end) <= 2 and count(distinct struct_pack(s := source, l := lang)) <= 4 live from f group by val),
s as (select r, kind, a, b, live, ['assign', 'access', 'hex', 'prefixed', 'mixed'][kind + 1] || ':' || a || ':' || b t from f join o using (val)),
w as (select * from s where kind < 3 or (live and not exists (select 1 from s z where z.r = s.r and z.kind < 3 and z.a <= s.a and z.b >= s.b))),
t as (select r, count(*) filter (kind = 0) n_assign, count(*) filter (kind = 1) n_access, count(*) filter (kind = 2) n_hex, string_agg(t, ',' order by a, kind) filter (kind < 3) base,
string_agg(t, ',' order by a, kind) spans, string_agg(t, ',' order by a, kind) filter (live) live from w group by r)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans, coalesce(live, '') live_spans
from d left join t using (r)
"""

FILL_IN_MIDDLE = """
with d as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') w, sha256('1:' || coalesce(cast(doc_id as varchar), '')) h from documents),
e as (select *, len(w) n, ('0x' || substr(h, 1, 8))::bigint % (len(w) + 1) a, ('0x' || substr(h, 9, 8))::bigint % (len(w) + 1) b, ('0x' || substr(h, 17, 8))::bigint % 100 c, ('0x' || substr(h, 25, 8))::bigint % 100 s from d),
f as (select doc_id, t, n, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or c >= 90 then 'plain' when s < 20 then 'spm' else 'psm' end form,
array_to_string(w[1:least(a, b)], '') p, array_to_string(w[least(a, b)+1:greatest(a, b)], '') m, array_to_string(w[greatest(a, b)+1:n], '') s from e)
select doc_id, cast(n as bigint) n, form, case when form <> 'plain' then length(p) end prefix_chars, case when form <> 'plain' then length(m) end middle_chars,
sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256, sha256(t) restored_sha256 from f
"""

_GRAMS = " union all ".join(f"select lang, {k} k, array_to_string(w[i:i+{k - 1}], ' ') g from (select lang, w, unnest(range(1, len(w)+1-{k - 1})) i from p)" for k in (1, 2, 3, 4))

COLLOCATIONS = rf"""
with t as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) p from documents),
p as (select lang, regexp_extract_all(p, '[^\x20\x09]+') w from t),
c as (select lang, k, g, count(*) f from ({_GRAMS}) group by all having count(*) >= 30),
tot as (select lang, sum(len(w)) n from p group by lang),
cand as (select lang, k, g, f, string_split(g, ' ') w from c where k > 1),
ext as (select lang, unnest([array_to_string(w[1:k-1], ' '), array_to_string(w[2:k], ' ')]) g, f from cand where k > 2),
kept as (select * from cand anti join (select lang, g, max(f) e from ext group by all) x on x.lang = cand.lang and x.g = cand.g and 100::hugeint * e >= 80::hugeint * f),
cut as (select lang, g, f a, w, k, unnest(range(1, k)) j from kept),
s as (select cut.lang, cut.g, a, j, l.f l, r.f r, cast(2000000::hugeint * a // (l.f + r.f) as bigint) score from cut join c l on l.lang = cut.lang and l.g = array_to_string(w[1:j], ' ') join c r on r.lang = cut.lang and r.g = array_to_string(w[j+1:cut.k], ' ')),
b as (select * from s qualify row_number() over (partition by lang, g order by score, j) = 1),
o as (select lang, row_number() over (partition by lang order by score desc, a desc, g) rank, g phrase, a, l, r, score from b)
select lang, rank, phrase, a, l, r, cast(n as bigint) n, score from o join tot using (lang) where rank <= 2000
"""

_ESC = r"regexp_replace(replace(text, '\', '\\'), '([<\[])(/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\\2', 'g')"

CHATS = rf"""
with c as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, {_ESC} esc, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\t\n\x0B\f\r ]')) + 4 n, row_number() over (partition by conv_id order by turn, role, text) - 1 pos from c),
f as (select *, coalesce(sum(n) over (partition by conv_id order by pos rows between unbounded preceding and 1 preceding), 0) before, max(case when pos = 0 and role = 'system' then n end) over (partition by conv_id) head,
max(case when pos = 0 and role = 'system' then length(esc) + 14 end) over (partition by conv_id) head_chars, length(role) + length(esc) + 8 chars from e),
g as (select *, greatest(2048 - 256 - coalesce(head, 0), 512) // 2 half from f),
h as (select *, before // half * 2 + cast(n > half as int) win from g),
runs as (select conv_id, win, min(pos) start, min(before) b, max(head_chars) head_chars, sum(chars) chars from h group by all),
past as (select runs.conv_id, runs.win, sum(h.chars) chars from runs join h on h.conv_id = runs.conv_id and h.pos between runs.start - 4 and runs.start - 1 and runs.b - h.before <= 256 and not (h.pos = 0 and h.role = 'system') group by all),
size as (select conv_id, sum(runs.chars + coalesce(past.chars, 0) + case when start > 0 then coalesce(head_chars, 0) else 0 end) chars from runs left join past using (conv_id, win) group by conv_id)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) turns_sha256, cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) loss_chars,
sha256(coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '')) loss_sha256, cast(any_value(size.chars) as bigint) formatted_chars from h join size using (conv_id) group by conv_id
"""
