"""SQL snippets for the DuckDB oracle texts (the same rules as the Spark operators,
written independently: line tables and window functions where Spark works in-row)."""

from __future__ import annotations

from patchtrace.functions.text import S


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


def diff_ctes(src: str, keys: list[str], prefix: str = "") -> str:
    """CTEs ``{prefix}parts`` (keys, part_no, file, diff_part, ctx, hl) from ``src``
    (keys..., diff_text) by a line table and running windows."""
    k = ", ".join(keys)
    p = prefix
    split_line = f"regexp_split_to_array({trim('line')}, '{S}+')"
    return f"""{p}d AS (SELECT {k}, string_split({trim('diff_text')}, chr(10)) AS ls FROM {src}),
{p}l AS (SELECT {k}, generate_subscripts(ls, 1) AS ln, unnest(ls) AS line FROM {p}d),
{p}c AS (SELECT *, starts_with(line, 'diff --git') AS is_file,
             (NOT starts_with(line, 'diff --git')) AND starts_with(line, '@@') AS is_hunk,
             CASE WHEN starts_with(line, 'diff --git') AND len({split_line}) >= 4
                  THEN substr({split_line}[4], 3) END AS path_set
      FROM {p}l),
{p}s AS (SELECT *, sum(CASE WHEN is_file OR is_hunk THEN 1 ELSE 0 END) OVER w AS seg_no,
               last_value(path_set IGNORE NULLS) OVER w AS cur_file
      FROM {p}c WINDOW w AS (PARTITION BY {k} ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{p}g AS (SELECT {k}, seg_no, bool_or(is_hunk) AS seg_is_hunk,
             max(CASE WHEN is_file OR is_hunk THEN line END) AS header,
             max(CASE WHEN is_file OR is_hunk THEN cur_file END) AS file,
             string_agg(line, chr(10) ORDER BY ln) AS diff_part,
             coalesce(list(line ORDER BY ln) FILTER (WHERE NOT (is_file OR is_hunk)), CAST([] AS VARCHAR[])) AS body
      FROM {p}s WHERE seg_no > 0 GROUP BY {k}, seg_no),
{p}h AS (SELECT *, coalesce({trim("string_split(header, '@@')[3]")}, '') AS ctx,
             list_filter(body, lambda x: NOT starts_with(x, 'index')) AS hl
      FROM {p}g WHERE seg_is_hunk),
{p}parts AS (SELECT {k}, CAST(row_number() OVER (PARTITION BY {k} ORDER BY seg_no) - 1 AS INTEGER) AS part_no,
             file, diff_part, header, ctx, hl,
             array_to_string(CASE WHEN ctx <> '' THEN list_prepend(ctx, o) ELSE o END, chr(10)) AS old_version
      FROM (SELECT *, list_transform(list_filter(hl, lambda x: NOT starts_with(x, '+')),
                        lambda x: CASE WHEN starts_with(x, '-') OR starts_with(x, ' ') THEN substr(x, 2) ELSE x END) AS o
            FROM {p}h)
      WHERE file IS NOT NULL AND file <> '' AND (ctx <> '' OR len(hl) > 0))"""


def rename_test(hl: str = "hl", ctx: str = "ctx") -> str:
    """SQL: whether a part's lines ``hl`` (with header context ``ctx``) only rename identifiers."""
    from patchtrace.operators import verdict as v

    def lines(sign: str) -> str:
        own = f"list_transform(list_filter({hl}, lambda x: starts_with(x, '{sign}')), lambda x: substr(x, 2))"
        kept = f"list_filter({own}, lambda x: NOT regexp_matches(x, {q(v.COMMENT_LINE)}))"
        return f"regexp_extract_all(array_to_string({kept}, chr(10)), {q(v.CODE_TOKEN)})"

    words = ", ".join(q(w) for w in v.USE_WORDS + v.TYPE_WORDS)
    uses = ", ".join(q(w) for w in v.USE_WORDS)

    def is_name(t: str) -> str:
        return (f"regexp_matches({t}[i], {q(v.NAME)}) AND {t}[i] NOT IN ({words}) AND coalesce({t}[i + 1], '') <> '(' "
                f"AND (i = 1 OR {t}[i - 1] NOT IN ('.', '>'))")

    def each(t: str, value: str) -> str:
        return f"list_transform(range(1, len({t}) + 1), lambda i: {value})"

    declared = f"{is_name('o')} AND i > 1 AND regexp_matches(o[i - 1], {q(v.NAME)}) AND o[i - 1] NOT IN ({uses})"
    return f"""(SELECT coalesce(bool_or(len(o) = len(n) AND len(o) > 0 AND om = nm AND len(ch) > 0
        AND len(p) = len(list_distinct(list_transform(p, lambda x: x.a))) AND len(p) = len(list_distinct(list_transform(p, lambda x: x.b)))
        AND list_has_all(dc, list_transform(ch, lambda x: x.a))
        AND NOT list_has_any(o, list_transform(ch, lambda x: x.b)) AND NOT list_has_any(n, list_transform(ch, lambda x: x.a))
        AND NOT list_has_any(ar, list_transform(ch, lambda x: x.a)) AND NOT list_has_any(ar, list_transform(ch, lambda x: x.b))), false)
      FROM (SELECT *, list_filter(p, lambda x: x.a <> x.b) AS ch FROM (
        SELECT *, CASE WHEN len(o) = len(n) AND om = nm THEN list_distinct({each('o', f"CASE WHEN {is_name('o')} THEN {{'a': o[i], 'b': n[i]}} END")}) ELSE [] END AS p
        FROM (SELECT o, n, ar, {each('o', f"CASE WHEN {is_name('o')} THEN ' ' ELSE o[i] END")} AS om,
                     {each('n', f"CASE WHEN {is_name('n')} THEN ' ' ELSE n[i] END")} AS nm,
                     list_distinct({each('o', f"CASE WHEN {declared} THEN o[i] END")}) AS dc
              FROM (SELECT {lines('-')} AS o, {lines('+')} AS n,
                           regexp_extract_all(array_to_string(list_prepend({ctx}, list_filter({hl}, lambda x: NOT (starts_with(x, '+') OR starts_with(x, '-')))), chr(10)), {q(v.CODE_TOKEN)}) AS ar)))))"""


def rule_scorer_cols(hl: str = "hl", file: str = "file", ctx: str = "ctx") -> tuple[str, str]:
    """SQL (is_functional, explanation) of the rule scorer over hunk lines ``hl``."""
    from patchtrace.operators import verdict as v

    def norm(sign: str) -> str:
        lines = f"list_transform(list_filter({hl}, lambda x: starts_with(x, '{sign}')), lambda x: substr(x, 2))"
        kept = f"list_filter({lines}, lambda x: NOT regexp_matches(x, {q(v.COMMENT_LINE)}))"
        sq = (f"list_transform({kept}, lambda x: regexp_replace(regexp_replace(x, '{S}', '', 'g'), "
              f"{q(v.VERSION_NUMBER)}, '#', 'g'))")
        return f"list_sort(list_filter({sq}, lambda x: x <> ''))"

    doc = f"regexp_matches({file}, {q(v.DOC_PATH)})"
    same = f"({norm('-')} = {norm('+')})"
    renamed = rename_test(hl, ctx)
    is_f = f"NOT ({doc} OR {same} OR {renamed})"
    expl = (f"CASE WHEN {doc} THEN {q(v.EXPLAIN_DOC)} WHEN {same} THEN {q(v.EXPLAIN_SAME)} "
            f"WHEN {renamed} THEN {q(v.EXPLAIN_RENAMED)} ELSE {q(v.EXPLAIN_CODE)} END")
    return is_f, expl


def lang_case(path: str, table: dict[str, list[str]]) -> str:
    sfx = f"lower(regexp_extract({path}, '[^/](\\.[^./]+)$', 1))"
    whens = " ".join(f"WHEN {sfx} IN ({', '.join(q(e) for e in exts)}) THEN {q(lang)}" for lang, exts in table.items())
    return f"CASE {whens} END"


def function_ctes(src: str, extra: bool = False, p: str = "") -> str:
    """CTEs ending in ``{p}functions`` (the extractor's output columns) over ``src``
    (path, content): brace plan and line plan by window functions."""
    from patchtrace.operators import extract as x

    table = dict(x.LANGUAGE_SUFFIXES, **(x.EXTRA_LANGUAGE_SUFFIXES if extra else {}))
    brace = ["c", "cpp", "java", "rust"] + (["csharp", "javascript"] if extra else [])

    def by_lang(idx_of):
        whens = []
        for lang in brace:
            pat, *groups = x.BRACE_RULES[lang]
            gi = idx_of(groups)
            expr = f"regexp_extract(t, {q(pat)}, {gi})" if gi is not None else "'fn'"
            whens.append(f"WHEN {q(lang)} THEN {expr}")
        return f"CASE language {' '.join(whens)} END"

    m = by_lang(lambda g: 0)
    name = by_lang(lambda g: g[0])
    kind = by_lang(lambda g: g[1] or None)
    params = by_lang(lambda g: g[2])
    nl = "(length({0}) - length(replace({0}, chr(10), '')))"
    lstrip = f"regexp_replace(line, '^{S}+', '')"
    ctes = f"""{p}lf AS (SELECT path, content, {lang_case('path', table)} AS language FROM {src}),
{p}bf AS (SELECT path, language, regexp_replace(regexp_replace(content, '//[^\\n]*', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g') AS code
          FROM {p}lf WHERE language IN ({', '.join(q(b) for b in brace)})),
{p}bs AS (SELECT path, language, generate_subscripts(segs, 1) AS i, unnest(segs) AS seg
          FROM (SELECT path, language, regexp_extract_all(code, '[^{{}}]*[{{}}]', 0) AS segs FROM {p}bf)),
{p}bw AS (SELECT *, right(seg, 1) = '{{' AS is_open, CAST(sum(length(seg)) OVER w AS BIGINT) AS e,
                 CAST(sum(CASE WHEN right(seg, 1) = '{{' THEN 1 ELSE -1 END) OVER w AS BIGINT) AS d,
                 CAST(sum({nl.format('seg')}) OVER w AS BIGINT) AS cnl
          FROM {p}bs WINDOW w AS (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{p}bo AS (SELECT *, coalesce(max(CASE WHEN is_open THEN e END) OVER (PARTITION BY path ORDER BY i
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev_e FROM {p}bw),
{p}bm AS (SELECT *, lead(e) OVER v AS close_e, lead(cnl) OVER v AS close_cnl, lead(is_open) OVER v AS close_open
          FROM (SELECT *, CASE WHEN is_open THEN d ELSE d + 1 END AS lvl FROM {p}bo)
          WINDOW v AS (PARTITION BY path, lvl ORDER BY i)),
{p}bt AS (SELECT *, CASE WHEN prev_e > 0 THEN chr(1) ELSE '' END || substr(code, prev_e + 1, e - prev_e) AS t
          FROM (SELECT m.*, b.code FROM {p}bm m JOIN {p}bf b USING (path)) WHERE is_open AND close_e IS NOT NULL AND NOT close_open),
{p}bx AS (SELECT path, language, e, cnl, close_e, close_cnl, {m} AS m, {name} AS name, {kind} AS kind, {params} AS params
          FROM {p}bt),
{p}bfn AS (SELECT x.path, x.language, name, {trim(f"{trim('kind')} || ' ' || name || params")} AS signature,
                  e - length(m) AS start_pos, close_e AS end_pos,
                  cnl - {nl.format('m')} + 1 AS start_line, close_cnl + 1 AS end_line,
                  {trim('substr(b.code, e - length(m) + 1, close_e - (e - length(m)))')} AS body
           FROM {p}bx x JOIN {p}bf b USING (path) WHERE m <> ''),
{p}pl AS (SELECT path, generate_subscripts(ls, 1) - 1 AS ln, unnest(ls) AS line
          FROM (SELECT path, string_split(content, chr(10)) AS ls FROM {p}lf WHERE language = 'python')),
{p}pw AS (SELECT *, CAST(sum(length(line) + 1) OVER w AS BIGINT) - length(line) - 1 AS off, count(*) OVER (PARTITION BY path) AS n_lines,
                 {trim('line')} <> '' AND NOT starts_with({trim('line')}, '#') AS sig,
                 length(line) - length({lstrip}) AS indent, regexp_extract(line, {q(x.PY_DEF)}, 2) AS sig_txt
          FROM {p}pl WINDOW w AS (PARTITION BY path ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{p}pd AS (SELECT * FROM {p}pw WHERE sig_txt <> ''),
{p}pb AS (SELECT DISTINCT path, indent AS bound FROM {p}pd),
{p}pn AS (SELECT path, ln, indent, bound, lead(ln) OVER v AS next_ln, lead(off) OVER v AS next_off
          FROM (SELECT s.path, s.ln, s.off, s.indent, b.bound FROM {p}pw s JOIN {p}pb b ON s.path = b.path AND s.indent <= b.bound WHERE s.sig)
          WINDOW v AS (PARTITION BY path, bound ORDER BY ln)),
{p}pe AS (SELECT d.*, coalesce(n.next_ln, d.n_lines) AS end_ln, n.next_off
          FROM {p}pd d LEFT JOIN (SELECT * FROM {p}pn WHERE indent = bound) n USING (path, ln)),
{p}pk AS (SELECT *, max(end_ln) OVER (PARTITION BY path ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
          FROM {p}pe),
{p}pfn AS (SELECT k.path, 'python' AS language, regexp_extract(line, {q(x.PY_DEF)}, 3) AS name, {trim('sig_txt')} AS signature,
                  off AS start_pos, CASE WHEN next_off IS NULL THEN length(f.content) ELSE next_off - 1 END AS end_pos,
                  ln + 1 AS start_line, end_ln AS end_line,
                  CASE WHEN next_off IS NULL THEN substr(f.content, off + 1) ELSE substr(f.content, off + 1, next_off - 1 - off) END AS body
           FROM {p}pk k JOIN {p}lf f USING (path) WHERE reach IS NULL OR reach <= ln)"""
    parts = [f"SELECT path, name, signature, body, start_line, end_line, language, start_pos, end_pos FROM {p}{t}"
             for t in ("bfn", "pfn")]
    if extra:
        ruby = ruby_ctes(p)
        ctes += ",\n" + ruby
        parts.append(f"SELECT path, name, signature, body, start_line, end_line, language, start_pos, end_pos FROM {p}rfn")
    union = "\n  UNION ALL ".join(parts)
    ctes += f""",
{p}functions AS (SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY start_pos) - 1 AS INTEGER) AS fn_no,
                 name, signature, body, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line,
                 language, CAST(start_pos AS BIGINT) AS start_pos, CAST(end_pos AS BIGINT) AS end_pos
          FROM ({union}))"""
    return ctes


def ruby_ctes(p: str = "") -> str:
    from patchtrace.operators import extract as x
    lstrip = f"regexp_replace(line, '^{S}+', '')"
    return f"""{p}rl AS (SELECT path, generate_subscripts(ls, 1) - 1 AS ln, unnest(ls) AS line
          FROM (SELECT path, string_split(content, chr(10)) AS ls FROM {p}lf WHERE language = 'ruby')),
{p}rw AS (SELECT *, CAST(sum(length(line) + 1) OVER w AS BIGINT) - length(line) - 1 AS off, length(line) - length({lstrip}) AS indent,
                 regexp_matches(line, {q(x.RUBY_DEF)}) AS is_def, regexp_matches(line, {q(x.RUBY_END)}) AS is_end
          FROM {p}rl WINDOW w AS (PARTITION BY path ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{p}rm AS (SELECT *, last_value(CASE WHEN NOT is_def THEN ln END IGNORE NULLS) OVER v AS end_ln,
                 last_value(CASE WHEN NOT is_def THEN off + length(line) END IGNORE NULLS) OVER v AS end_off
          FROM {p}rw WHERE is_def OR is_end
          WINDOW v AS (PARTITION BY path, indent ORDER BY ln DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{p}rfn AS (SELECT r.path, 'ruby' AS language, regexp_extract(line, {q(x.RUBY_DEF)}, 2) AS name, {trim('line')} AS signature,
                  off + indent AS start_pos, end_off AS end_pos, ln + 1 AS start_line, end_ln + 1 AS end_line,
                  substr(f.content, off + indent + 1, end_off - off - indent) AS body
           FROM {p}rm r JOIN {p}lf f USING (path) WHERE is_def AND end_ln IS NOT NULL)"""


def tokens(text: str, special: bool = True) -> str:
    from patchtrace.operators import embed as e
    t = f"regexp_extract_all({text}, {q(e.TOKEN_PATTERN)}, 0)"
    return f"list_concat(['<s>'], {t}, ['</s>'])" if special else t


def bucket(tok: str) -> str:
    h = "'0123456789abcdef'"
    return f"((strpos({h}, substr(md5({tok}), 7, 1)) - 1) * 16 + strpos({h}, substr(md5({tok}), 8, 1)) - 1)"


def n_windows(L: str) -> str:
    return f"(CASE WHEN {L} < 2 THEN 0 WHEN {L} <= 512 THEN 1 ELSE CAST(ceil(({L} - 512) / 256.0) AS INTEGER) + 1 END)"


def embed_ctes(src: str, key: list[str], text: str, p: str, special: bool = True, per_window: bool = False) -> str:
    """CTEs ending in ``{p}vec(key..., embedding)``: windows exploded, tokens of each
    window counted per bucket, mean over windows (or per window with ``per_window``)."""
    k = ", ".join(key)
    kk = key + (["w"] if per_window else [])
    kks = ", ".join(kk)
    on = " AND ".join(f"s.{c} = ks.{c}" for c in kk)
    den = "1.0" if per_window else "ks.nw"
    return f"""{p}tw AS (SELECT {k}, toks, len(toks) AS L, {n_windows('len(toks)')} AS nw
          FROM (SELECT {k}, {tokens(text, special)} AS toks FROM {src})),
{p}wn AS (SELECT {k}, toks, L, nw, unnest(range(nw)) AS w FROM {p}tw WHERE nw > 0),
{p}wt AS (SELECT {k}, w, nw, unnest(toks[w * 256 + 1 : least(w * 256 + 512, L)]) AS t FROM {p}wn),
{p}sp AS (SELECT {kks}, {bucket('t')} AS b, count(*) AS n FROM {p}wt GROUP BY ALL),
{p}ks AS (SELECT DISTINCT {kks}, nw FROM {p}wn),
{p}vec AS (SELECT {', '.join('ks.' + c + ' AS ' + c for c in kk)},
                  list(coalesce(CAST(s.n AS DOUBLE), 0.0) / {den} ORDER BY g.b) AS embedding
           FROM {p}ks ks CROSS JOIN (SELECT range AS b FROM range(256)) g
           LEFT JOIN {p}sp s ON {on} AND s.b = g.b
           GROUP BY ALL)"""


def round_list(x: str, digits: int = 6) -> str:
    return f"list_transform({x}, lambda v: round(v, {digits}))"


def node_kind_case(path: str) -> str:
    from patchtrace.operators.spans import SUFFIX_NODE_KIND
    sfx = f"lower(regexp_extract({path}, '[^/](\\.[^./]+)$', 1))"
    return "CASE " + " ".join(f"WHEN {sfx} = {q(s)} THEN {q(k)}" for s, k in SUFFIX_NODE_KIND.items()) + " END"


def dump_node(kind: str, sl: str, el: str) -> str:
    """The derived dump text of one function (see queries.dump rows)."""
    r1, r2 = f"CAST({sl} - 1 AS VARCHAR)", f"CAST({el} - 1 AS VARCHAR)"
    return (f"chr(10) || '  (' || {kind} || ' [' || {r1} || ', 0] - [' || {r2} || ', 1]' || chr(10) || "
            f"'    name: (identifier [' || {r1} || ', 4] - [' || {r1} || ', 7]))' || chr(10) || "
            f"'  (comment [' || {r2} || ', 0] - [' || {r2} || ', 2])'")
