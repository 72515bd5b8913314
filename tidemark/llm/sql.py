"""DuckDB twins of the corpus queries."""

OP1 = """
with t as (select doc_id, coalesce(text, '') as text from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(text) as text_sha256
from t window w as (partition by text)
"""

OP2 = r"""
with docs as (select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as text from documents),
cut as (
  select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from docs),
counted as (
  select doc_id, stratum, words, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::bigint as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         len(lines) as n_lines, len(regexp_extract_all(text, '[!?]')) as marks, len(regexp_extract_all(text, '\p{Lu}{3,}')) as capitals
  from cut),
wins as (
  select doc_id, unnest(range(1, n_words - 6)) as pos, words from counted where n_words >= 8),
keyed as (select doc_id, pos, array_to_string(list_slice(words, pos, pos + 7), ' ') as w from wins),
twice as (select doc_id, pos, count(*) over (partition by doc_id, w) as c from keyed),
gaps as (select doc_id, least(8, coalesce(lead(pos) over (partition by doc_id order by pos) - pos, 8)) as g from twice where c > 1),
repeats as (select doc_id, sum(g)::bigint as n_repeat_words from gaps group by doc_id),
measured as (
  select c.*, coalesce(r.n_repeat_words, 0) as n_repeat_words,
         coalesce((select count(*) from (select unnest(range(2, n_words + 1)) as i) where words[i] = words[i - 1]), 0) as doubled
  from counted c left join repeats r using (doc_id)),
valued as (
  select doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
         [{'rule': 'symbols', 'value': n_symbols * 1000 // greatest(word_chars, 1)}, {'rule': 'marks', 'value': marks * 1000 // greatest(n_words, 1)},
          {'rule': 'capitals', 'value': capitals * 1000 // greatest(n_words, 1)}, {'rule': 'dup_lines', 'value': n_dup_lines * 1000 // greatest(n_lines, 1)},
          {'rule': 'repeat_words', 'value': n_repeat_words * 1000 // greatest(n_words, 1)}, {'rule': 'doubled', 'value': doubled * 1000 // greatest(n_words, 1)}] as vs
  from measured),
long as (select doc_id, stratum, unnest(vs, recursive := true) from valued),
known as (select doc_id, min(quality) = 1 as good, substr(md5(doc_id::varchar), 1, 1) < '8' as certify from labels where doc_id is not null and quality is not null group by doc_id),
labelled as (select stratum, rule, value, good, certify from long join known using (doc_id)),
tests as (select count(distinct (stratum, rule)) as tests from labelled),
tried as (
  select stratum, rule, cutoff, count(*) filter (good and certify) as n, count(*) filter (good and certify and value > cutoff) as k,
         count(*) filter (not good and not certify and value > cutoff) - 20 * count(*) filter (good and not certify and value > cutoff) as gain
  from labelled, (select unnest([5, 10, 20, 30, 50, 75, 100, 150, 200, 300, 400, 500, 600, 700, 800]) as cutoff) group by all),
certified as (
  select * from tried, tests where n > 0 and gain > 0 and k < 0.01 * n
  and list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)))) <= 0.05 / tests),
best as (select stratum, rule, cutoff from certified qualify row_number() over (partition by stratum, rule order by gain desc, cutoff desc) = 1),
failing as (select doc_id, count(*) as n from long join best using (stratum, rule) where value > cutoff group by doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and coalesce(f.n, 0) = 0 as kept
from valued left join failing f using (doc_id)
"""

OP3 = r"""
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
wins as (select doc_id, unnest(range(1, len(words) - 18)) as pos, words from docs where len(words) >= 20),
keyed as (select doc_id, pos, hash(array_to_string(list_slice(words, pos, pos + 19), ' ')) as k, md5(array_to_string(list_slice(words, pos, pos + 19), ' ')) as w from wins),
ranked as (select doc_id, pos, row_number() over (partition by k, w order by doc_id, pos) as r from keyed),
covered as (select distinct doc_id, unnest(range(pos, pos + 20)) as pos from ranked where r > 1),
each as (select doc_id, unnest(range(1, len(words) + 1)) as pos, unnest(words) as w from docs),
kept as (
  select e.doc_id, count(*) filter (c.pos is not null) as n_removed, string_agg(case when c.pos is null then w end, ' ' order by e.pos) as kept
  from each e left join covered c on e.doc_id = c.doc_id and e.pos = c.pos group by e.doc_id)
select docs.doc_id, len(words)::bigint as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from docs left join kept using (doc_id)
"""

OP7 = r"""
with slim as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5('mix' || coalesce(doc_id::varchar, 'null')) as key
  from documents),
sizes as (select source, sum(size)::bigint as source_size from slim group by source),
weighed as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from sizes),
leveled as (
  select *, 3 * coalesce(sum(source_size) over (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)::bigint as capped,
         sum(weight) over (order by source_size / weight, source nulls last rows between current row and unbounded following)::bigint as rest,
         sum(source_size) over ()::bigint as total
  from weighed),
opened as (select capped, rest from leveled where (total - capped) * weight <= 3 * source_size * rest
           order by source_size / weight, source nulls last limit 1),
targets as (
  select source, source_size, case when 3 * source_size <= ((total - o.capped) * weight) / o.rest then (3 * source_size)::double
         else ((total - o.capped) * weight) / o.rest end as target
  from leveled, opened o),
ranked as (
  select doc_id, slim.source, size, key, source_size, target,
         sum(size) over (partition by slim.source order by key, doc_id, size rows unbounded preceding)::bigint as upto
  from slim join targets on slim.source is not distinct from targets.source),
entries as (select *, (upto + copy * source_size) / target as finish from ranked, (select unnest([0, 1, 2]) as copy) where size > 0),
cut as (select *, sum(size) over (order by finish, key, doc_id, size, copy rows unbounded preceding) <= (select sum(size) from slim) as fits from entries),
copies as (select doc_id, sum(case when fits then size else 0 end)::bigint as taken from cut group by doc_id)
select ranked.doc_id, size, source_size, target, coalesce(taken, 0) as taken
from ranked left join copies on ranked.doc_id is not distinct from copies.doc_id
"""

OP9 = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
       sum(length(regexp_replace(role, '[\\<\[]', '..', 'g')) + length(regexp_replace(text, '[\\<\[]', '..', 'g')) + 17)::bigint as formatted_chars
from rows group by conv_id
"""


def crc32(text: str) -> str:
    """Unsigned checksum of an ASCII text, bit by bit: each byte is followed by seven zeros, one for each further shift."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {bits}), lambda a, b: {step}), 4294967295)"


#: A run is a longest stretch over which words ``period`` apart are equal.  Where
#: it starts, 16 words stand again one period on, since it has 24 words and three
#: periods at least: all distances of equal 16 words are tried as periods.
OP11 = rf"""
with given as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words, {crc32("doc_id::varchar")} as h from documents),
placed as (select *, len(words) as n, h // 10 as g from given),
cuts as (select *, case when h % 10 = 0 and n > 0 then g % n else n end as a from placed),
docs as (
  select row_number() over () as doc, doc_id, n,
         case when a = n then words else list_transform(range(0, n), lambda i: words[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end]) end as words
  from cuts),
grams as (select doc, n, unnest(range(1, n - 14)) as pos, words from docs where n >= 24),
keyed as (select doc, n, pos, hash(list_slice(words, pos, pos + 15)) as k from grams),
periods as (select distinct x.doc, y.pos - x.pos as q from keyed x join keyed y on x.doc = y.doc and x.k = y.k and x.pos < y.pos and 3 * (y.pos - x.pos) <= x.n),
equal as (
  select doc, q, unnest(list_filter(range(1, n - q + 1), lambda i: words[i] = words[i + q])) as pos
  from periods join docs using (doc)),
islands as (select doc, q, pos, pos - row_number() over (partition by doc, q order by pos) as island from equal),
stretches as (select doc, q, min(pos) - 1 as start, count(*) + q as length from islands group by doc, q, island),
runs as (select doc, start, length, min(q) as period from stretches where length >= greatest(24, 3 * q) group by doc, start, length),
listed as (
  select doc, count(*) as n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' order by start, period) as lines
  from runs group by doc),
best as (select * from runs qualify row_number() over (partition by doc order by length::double / period desc, start, period) = 1),
dropped as (select doc, list(distinct pos) as gone from (select doc, unnest(range(start + period, start + length)) as pos from runs) group by doc)
select doc_id, coalesce(n_runs, 0) as n_runs, best.start, best.length, best.period, (1000 * best.length) // best.period as exponent_milli,
       sha256(coalesce(lines, '')) as runs_sha256,
       sha256(array_to_string(case when gone is null then words else list_filter(words, lambda w, i: not list_contains(gone, i - 1)) end, ' ')) as collapsed_sha256
from docs left join listed using (doc) left join best using (doc) left join dropped using (doc)
"""

def put(cost: str, letter: str, best: str) -> str:
    """``best`` with one more edit in front."""
    return f"lpad((left({best}, 8)::bigint + {cost})::varchar, 8, '0') || '{letter}' || substr({best}, 9)"


#: States of the edits: 1 nothing yet, 2 after s, 3 after u, 4 after a.  A state's
#: best edits are its cost, eight digits wide, and its audit in one string, built
#: from the last row on; each row is one step, then two steps insert rows.
OP12 = rf"""
with given as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         {crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as fault
  from conversations),
damaged as (
  select conv_id, turn, case when fault = 4 then 'user' else role end as role,
         case when fault = 1 then '' when fault = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(range(0, case when fault = 3 then 2 else 1 end)) as copy
  from given where fault <> 0),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as k from damaged),
seen as (select *, row_number() over (partition by conv_id, role, text order by k) > 1 as again, lag(role) over (partition by conv_id order by k) as before from numbered),
judged as (
  select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when again then 'duplicate'
                 when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else '' end as fault
  from seen),
gathered as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
         count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
         count(*) filter (k > 1 and left(before, 1) || left(role, 1) not in ('su', 'ua', 'au')) as illegal,
         list(role order by k) as roles, list(text order by k) as texts,
         list({{'kind': 'row', 'role': left(role, 1), 'gone': fault in ('blank', 'duplicate'), 'short': (fault = 'truncated')::bigint, 'best': null::varchar[]}}
              order by k desc) as rows
  from judged group by conv_id),
steps as (
  select *, list_concat([{{'kind': 'end', 'role': '', 'gone': false, 'short': 0::bigint, 'best': ['00000000', '00000004II', '00000002I', '00000000']}}],
    flatten(list_transform(rows, lambda r: [r, {{'kind': 'add', 'role': '', 'gone': false, 'short': 0::bigint, 'best': null::varchar[]}},
                                            {{'kind': 'add', 'role': '', 'gone': false, 'short': 0::bigint, 'best': null::varchar[]}}]))) as todo
  from gathered),
solved as (
  select *, list_reduce(todo, lambda x, y: {{'kind': 'row', 'role': '', 'gone': false, 'short': 0::bigint, 'best':
    case when y.kind = 'add'
    then [least(x.best[1], {put("2", "I", "x.best[3]")}), least(x.best[2], {put("2", "I", "x.best[3]")}),
          least(x.best[3], {put("2", "I", "x.best[4]")}), least(x.best[4], {put("2", "I", "x.best[3]")})]
    else list_transform(x.best, lambda b, state: least({put("3", "D", "b")},
      case when not y.gone then {put("2 + y.short", "R", "x.best[case when state = 3 then 4 else 3 end]")} end,
      case when not y.gone and y.role = 's' and state = 1 then {put("y.short", "K", "x.best[2]")}
           when not y.gone and y.role = 'u' and state <> 3 then {put("y.short", "K", "x.best[3]")}
           when not y.gone and y.role = 'a' and state = 3 then {put("y.short", "K", "x.best[4]")} end)) end}}).best[1] as won
  from steps),
told as (
  select *, left(won, 8)::bigint as cost, substr(won, 9) as audit,
    list_reduce(list_concat([{{'letter': '', 'state': 1, 'k': 0, 'said': ''}}],
                            list_transform(string_split(substr(won, 9), ''), lambda c: {{'letter': c, 'state': 0, 'k': 0, 'said': ''}})),
      lambda x, y: {{'letter': '',
        'state': case when y.letter in ('D', '') then x.state when y.letter = 'K' and left(roles[x.k + 1], 1) = 's' then 2 when x.state = 3 then 4 else 3 end,
        'k': case when y.letter in ('I', '') then x.k else x.k + 1 end,
        'said': case when y.letter in ('D', '') then x.said
          else x.said || chr(10) || case when y.letter = 'K' then roles[x.k + 1] when x.state = 3 then 'assistant' else 'user' end || ':'
               || case when y.letter = 'I' then '' else texts[x.k + 1] end end}}).said as said
  from solved),
ids as (select distinct conv_id from conversations)
select ids.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit, sha256(coalesce(substr(said, 2), '')) as repaired_sha256
from ids left join told on ids.conv_id is not distinct from told.conv_id
"""

OP13 = """
with given as (select page_id, coalesce(html, '') as html from pages),
kept as (select *, strlen(html) as bytes, max(page_id) over (partition by html) as last from given)
select page_id, bytes as payload_bytes, sha1(html) as payload_digest, case when bytes >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
       case when bytes >= 1000 and page_id <> last then last end as refers_to
from kept
"""
