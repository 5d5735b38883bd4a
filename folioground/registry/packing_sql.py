"""The packing rules in DuckDB SQL, for any size and overlap: a recursive query that takes a page piece by piece.

Written from the rules and apart from the packer: blocks come from window functions over lines, oversize blocks from lists.
"""

from __future__ import annotations

from folioground.registry.sql_views import WS, fold, meaningful, n_words, strip, with_views, words

_STATE = "version_id, page_number, n, held, parts, head, tried, made, out_text, phase"


def packed_sql(body: str, lines: dict[str, str], size: int, overlap: int, heading: str, table: str) -> str:
    """``body`` over ``chunk``: version_id, page_number, idx_in_page, chunk_index, section_heading, carried, t, start, stop.

    ``lines`` ends in a view ``page_line`` (version_id, page_number, line_no, line); ``heading`` and ``table`` tell kinds of a line ``s``.
    """
    text = "array_to_string(k.parts, chr(10) || chr(10))"
    by_line = "over (partition by version_id, page_number order by line_no rows unbounded preceding)"
    page = "partition by version_id, page_number order by idx_in_page rows between unbounded preceding"
    views = {
        **lines,
        "k0": f"select *, {strip('line')} as s from page_line",
        "kinded": f"select *, case when {heading} then 'HEADING' when {table} then 'TABLE' else 'PARAGRAPH' end as kind from k0 where s <> ''",
        "b1": "select *, lag(kind) over w as pk, line_no - lag(line_no) over w > 1 as gap from kinded window w as (partition by version_id, page_number order by line_no)",
        "b2": f"""select *, sum(case when pk is null or kind = 'HEADING' or pk = 'HEADING' or pk <> kind or (kind = 'PARAGRAPH' and gap) then 1 else 0 end) {by_line} as block_no,
          last_value(nullif({strip("case when kind = 'HEADING' then ltrim(s, '#') end")}, '') ignore nulls) {by_line} as under from b1""",
        "block": f"""select version_id, page_number, block_no, min(kind) as kind, min(under) as under,
          {strip("string_agg(case when kind = 'HEADING' then s else regexp_replace(line, '" + WS + "+$', '') end, chr(10) order by line_no)")} as t from b2 group by version_id, page_number, block_no""",
        "sentence": f"""select * exclude (ss), unnest(ss) as st, unnest(generate_series(1, len(ss))) as sent_no from (select *, kind <> 'HEADING' and {n_words('t')} > {size} as big,
          case when kind <> 'HEADING' and {n_words('t')} > {size} then list_filter(string_split(regexp_replace(t, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') else [t] end as ss from block)""",
        "window_": f"select *, unnest(generate_series(0, case when big then (len(ws) - 1) // {size} else 0 end)) as win_no from (select *, {words('st')} as ws from sentence)",
        "piece": f"""select version_id, page_number, kind, under, big, big and sent_no = 1 and win_no = 0 as opens,
          case when big and len(ws) > {size} then array_to_string(ws[win_no * {size} + 1 : (win_no + 1) * {size}], ' ') else st end as t,
          case when big and len(ws) > {size} then ws[win_no * {size} + 1 : (win_no + 1) * {size}] else ws end as ws,
          row_number() over (partition by version_id, page_number order by block_no, sent_no, win_no) as n from window_""",
        "last_piece": "select version_id, page_number, max(n) as last_n from piece group by version_id, page_number",
        # A step takes the next piece, or closes the chunk: before a piece without room, after a piece that fills it, at the end.
        f"pack({_STATE})": f"""
 select version_id, page_number, 0::bigint, []::varchar[], []::varchar[], null::varchar, 0, 0, null::varchar, 'take' from last_piece
 union all
 select version_id, page_number, case when act = 'take' then n + 1 else n end,
  case when act = 'take' then held || ws when carry then held[-{overlap}:] else []::varchar[] end,
  case when act = 'take' then parts || [t] when carry then [array_to_string(held[-{overlap}:], ' ')] else []::varchar[] end,
  head, case when act = 'close' and phase = 'take' then tried + 1 else 0 end, case when act <> 'take' and ok then made + 1 else made end,
  case when act <> 'take' and ok then body end, case when act = 'end' then 'done' when act = 'take' and big and len(held) + len(ws) >= {size} then 'full' else 'take' end
 from (
  select k.version_id, k.page_number, k.n, k.held, k.parts, k.tried, k.made, k.phase, p.ws, p.t, p.big, case when k.phase = 'full' then k.head else coalesce(p.under, k.head) end as head,
   {text} as body, {meaningful(text)} as ok, {meaningful(text)} and len(k.held) > {overlap} as carry,
   case when k.phase = 'full' then 'close' when k.n = e.last_n then 'end' when p.kind = 'HEADING' or len(k.held) = 0 then 'take'
    when p.opens and k.tried = 0 then 'close' when k.tried <= p.opens::int and len(k.held) + len(p.ws) > {size} then 'close' else 'take' end as act
  from pack k join last_piece e using (version_id, page_number) left join piece p on p.version_id = k.version_id and p.page_number = k.page_number and p.n = k.n + 1
  where k.phase <> 'done')""",
        "made_": "select version_id, page_number, cast(made - 1 as int) as idx_in_page, head as section_heading, out_text as t from pack where out_text is not null",
        "chunk": f"""select *, start + length(t) as stop from (select *, cast(row_number() over (partition by version_id order by page_number, idx_in_page) - 1 as int) as chunk_index,
          last_value(section_heading ignore nulls) over (partition by version_id order by page_number, idx_in_page rows unbounded preceding) as carried,
          coalesce(sum(length(t) + 1) over ({page} and 1 preceding), 0) as start from made_)""",
    }
    return with_views("v_lines", extra=views, body=body).replace("with ", "with recursive ", 1)


CHUNK_ID = "version_id || ':' || page_number || ':' || chunk_index as vector_id"


def chunk_rows(heading: str = "section_heading") -> str:
    """Finished chunk rows, as ``describe_chunks`` gives them."""
    n = n_words("t")
    return f"""select {CHUNK_ID}, version_id, page_number, cast(page_number as varchar) as page_range, chunk_index, {heading} as section_heading, t as chunk_text, {fold('t')} as normalized_text,
 cast({n} as int) as word_count, cast(greatest(1, floor({n} * 1.3)) as int) as token_count, cast(start as int) as start_char_offset, cast(stop as int) as end_char_offset from chunk"""
