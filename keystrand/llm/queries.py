"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from keystrand.llm.decontaminate import op9_suffix_automaton_decontamination
from keystrand.llm.html_extract import op2_site_style_tree
from keystrand.llm.near_dedup import op1_prob_minhash_dedup
from keystrand.llm.packing import op4_lexical_retrieval_packing
from keystrand.llm.pii import op5_semi_markov_pii
from keystrand.llm.quality_classifier import op6_attention_quality
from keystrand.llm.quality_rules import op10_weak_supervision_quality
from keystrand.llm.rans import op3_rans_token_store
from keystrand.llm.sharding import op7_hypergeometric_shuffle
from keystrand.llm.toxicity import op8_compression_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_prob_minhash_dedup,
        op2_site_style_tree,
        op3_rans_token_store,
        op4_lexical_retrieval_packing,
        op5_semi_markov_pii,
        op6_attention_quality,
        op7_hypergeometric_shuffle,
        op8_compression_toxicity,
        op9_suffix_automaton_decontamination,
        op10_weak_supervision_quality,
    )
}

#: Normalised words in DuckDB: ASCII lower case, runs of letters, digits and non-ASCII characters.
_WORDS = "coalesce(regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"

#: What SQL can express whole: a trained model, a tokenizer, a random draw or markup has none.
ORACLES: dict[str, str] = {
    "op9_suffix_automaton_decontamination": f"""
with items as (select cast(item_id as varchar) as name, {_WORDS.format("text")} as w from benchmark),
sized as (select name, w, least(len(w), 13) as size from items where len(w) > 0),
windows as (select distinct name, size, array_to_string(w[i : i + size - 1], ' ') as gram from (select *, unnest(range(1, len(w) - size + 2)) as i from sized)),
docs as (select row_number() over () as r, doc_id, {_WORDS.format("text")} as w from documents),
places as (select r, w, size, unnest(range(1, len(w) - size + 2)) as i from docs, (select distinct size from windows)),
hits as (select r, i, p.size, name from (select *, array_to_string(w[i : i + size - 1], ' ') as gram from places) p join windows v on v.gram = p.gram and v.size = p.size),
covered as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + size)) as p from hits) group by r),
found as (select r, list_sort(list(distinct name)) as names from hits group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, cast(coalesce(len(names), 0) as bigint) as n_items,
    sha256(coalesce(array_to_string(names, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join covered using (r) left join found using (r)
""",
}
