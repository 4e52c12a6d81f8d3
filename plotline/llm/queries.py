"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from plotline.llm.ann import op6_multi_index
from plotline.llm.chat import op4_reply_trees
from plotline.llm.collocations import op12_hat_trie_collocations
from plotline.llm.html_extract import op7_template_removal
from plotline.llm.minhash import op5_bbit_minhash
from plotline.llm.mixing import op2_pivotal_mix
from plotline.llm.packing import op10_vector_best_fit
from plotline.llm.pii import op3_information_privacy
from plotline.llm.quality import op9_suffix_repetition
from plotline.llm.sharding import op8_virtual_slots
from plotline.llm.suffix_dedup import op1_suffix_array
from plotline.llm.toxicity import op13_noisy_channel_toxicity
from plotline.llm.whitening import op11_chebyshev_whitening

QUERIES = (op1_suffix_array, op2_pivotal_mix, op3_information_privacy, op4_reply_trees, op5_bbit_minhash, op6_multi_index, op7_template_removal, op8_virtual_slots, op9_suffix_repetition, op10_vector_best_fit, op11_chebyshev_whitening, op12_hat_trie_collocations, op13_noisy_channel_toxicity)

_WORD = r"[^\x20\x09-\x0D]+"

ORACLE_OP4 = r"""
with given as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc as (select *, regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') as body from given)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
 length(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
 cast(sum(length('<|im_start|>') + length(role) + 1 + length(body) + length('<|im_end|>') + 1) as bigint) as formatted_chars
from esc group by conv_id
"""

ORACLE_OP5 = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as ws from documents),
s as (select doc_id, unnest(list_distinct(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) end)) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
inter as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select x, y from inter join n nx on x = nx.doc_id join n ny on y = ny.doc_id where 100 * c >= 80 * (nx.n + ny.n - c)),
reach as (select doc_id, doc_id as r from documents union select reach.doc_id, y from reach join links on r = x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d left join n on d.doc_id = n.doc_id join (select doc_id, min(r) as component_id from reach group by doc_id) c on d.doc_id = c.doc_id
"""


def _repeated(size: int) -> str:
    """Words inside windows of ``size`` words that occur twice or more in their text, by document."""
    return rf"""select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + {size})) as p from (select doc_id, i, count(*) over (partition by doc_id, g) as k
 from (select doc_id, i, md5(array_to_string(ws[i : i + {size - 1}], ' ')) as g from (select doc_id, ws, unnest(range(1, len(ws) - {size - 2})) as i from w where len(ws) >= {size}))) where k > 1) group by doc_id"""


ORACLE_OP9 = rf"""
with w as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as ls from documents),
r3 as ({_repeated(3)}), r10 as ({_repeated(10)}), r301 as ({_repeated(301)}),
f as (select w.doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
 len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(r3.n, 0) as n_repeat_words, coalesce(r10.n, 0) as covered_words, coalesce(r301.n, 0) as long_words
 from w left join r3 on w.doc_id = r3.doc_id left join r10 on w.doc_id = r10.doc_id left join r301 on w.doc_id = r301.doc_id)
select doc_id, n_words, coalesce(word_chars, 0) as word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
 not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and covered_words <= 0.3 * n_words and long_words = 0 as kept, covered_words from f
"""

ORACLE_OP12 = r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d)),
g as (select lang, m, array_to_string(ws[i : i + m - 1], ' ') as phrase from (select lang, ws, m, unnest(range(1, len(ws) - m + 2)) as i from w, (select unnest([1, 2, 3, 4, 5]) as m) where len(ws) >= m)),
f as (select lang, m, phrase, count(*) as a from g group by all having count(*) >= 100),
n as (select lang, sum(len(ws)) as n from w group by lang),
c as (select lang, m, phrase, a, string_split(phrase, ' ') as ws from f where m > 1),
k as (select lang, phrase, a, ws, m, unnest(range(1, m)) as k from c),
s as (select k.lang, k.phrase, k.a, l.a as l, r.a as r, k, n.n, (1000::hugeint * k.a * n.n) // (l.a::hugeint * r.a) as score from k
 join f l on l.lang = k.lang and l.m = k and l.phrase = array_to_string(ws[1 : k], ' ')
 join f r on r.lang = k.lang and r.m = k.m - k and r.phrase = array_to_string(ws[k + 1 : k.m], ' ') join n on n.lang = k.lang),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
i as (select lang, a, ws, m, unnest(range(2, m)) as h from c where m > 2),
j as (select lang, a, array_to_string(ws[x : x + h - 1], ' ') as phrase from (select lang, a, ws, h, unnest(range(1, m - h + 2)) as x from i)),
kept as (select b.* from b left join (select lang, phrase, max(a) as longer from j group by all) j on j.lang = b.lang and j.phrase = b.phrase where longer is null or 100 * longer < 100 * b.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score
from kept qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000
"""


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_reply_trees": ORACLE_OP4, "op5_bbit_minhash": ORACLE_OP5, "op9_suffix_repetition": ORACLE_OP9, "op12_hat_trie_collocations": ORACLE_OP12}
