"""DuckDB SQL of the splitter and the packer, for texts without lists, tables and code (as the given ones are)."""

from __future__ import annotations


def tokens(n: str) -> str:
    return f"(CASE WHEN {n} = 0 THEN 0 ELSE greatest(1, trunc({n} * 1.3::DOUBLE)::INT) END)"


def words(x: str) -> str:
    return rf"regexp_extract_all({x}, '\S+')"


def count(x: str) -> str:
    return tokens(f"len({words(x)})")


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sentences(x: str) -> str:
    return rf"list_filter(string_split(regexp_replace({strip(x)}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda z: z <> '')"


def share(n: str) -> str:
    return f"trunc({n} / 1.3::DOUBLE)::INT"


def windows(x: str, size: str, overlap: str) -> str:
    most = f"greatest(1, {share(size)})"
    step = f"greatest(1, {most} - greatest(0, {share(overlap)}))"
    last = f"greatest(0, ceil((len({words(x)}) - {most}) / ({step})::DOUBLE))::BIGINT"
    return f"list_transform(range(0, {last} + 1), lambda k: array_to_string({words(x)}[k * {step} + 1:k * {step} + {most}], ' '))"


def split(source: str, keys: str) -> str:
    """A query: keys and `chunks` (a list) of the rows (keys, text, size, overlap) of `source`."""
    kept = f"CASE WHEN len({words('a.text')}) <= greatest(1, {share('overlap')}) THEN a.text ELSE array_to_string({words('a.text')}[-greatest(1, {share('overlap')}):], ' ') END"
    small = "[{'text': p, 'run': -1}]"
    large = f"list_transform(flatten(list_transform({sentences('p')}, lambda s: CASE WHEN {count('s')} <= size THEN [s] ELSE {windows('s', 'size', 'overlap')} END)), lambda q: {{'text': q, 'run': i::INT}})"
    fold = f"""list_reduce(list_transform(pieces, lambda p: {{'chunks': []::VARCHAR[], 'text': p.text, 'words': len({words('p.text')})::INT, 'run': p.run}}), lambda a, x: CASE
      WHEN x.text = '' THEN a WHEN a.text = '' THEN x
      WHEN a.run <> x.run THEN {{'chunks': list_append(a.chunks, a.text), 'text': x.text, 'words': x.words, 'run': x.run}}
      WHEN {tokens('(a.words + x.words)')} > size THEN {{'chunks': list_append(a.chunks, a.text),
        'text': CASE WHEN overlap > 0 THEN {kept} || chr(10) || chr(10) ELSE '' END || x.text,
        'words': (CASE WHEN overlap > 0 THEN least(a.words, greatest(1, {share('overlap')})) ELSE 0 END + x.words)::INT, 'run': x.run}}
      ELSE {{'chunks': a.chunks, 'text': a.text || chr(10) || chr(10) || x.text, 'words': (a.words + x.words)::INT, 'run': x.run}} END,
      {{'chunks': []::VARCHAR[], 'text': '', 'words': 0::INT, 'run': -2::INT}})"""
    return rf"""SELECT {keys}, CASE WHEN t = '' THEN []::VARCHAR[] WHEN {count('t')} <= size THEN [t] WHEN f.text = '' THEN f.chunks ELSE list_append(f.chunks, f.text) END AS chunks FROM (
  SELECT {keys}, t, size, {fold} AS f FROM (
    SELECT {keys}, t, size, overlap, flatten(list_transform(list_filter(list_transform(string_split_regex(t, '\n\s*\n'), lambda x: {strip('x')}), lambda x: x <> ''),
      lambda p, i: CASE WHEN {count('p')} <= size THEN {small} ELSE {large} END)) AS pieces
    FROM (SELECT {keys}, {strip('text')} AS t, size::INT AS size, overlap::INT AS overlap FROM {source})))"""


def pack(parts: str, size: str, cost: str) -> str:
    """The texts of a list packed up to a size, with a cost for each chunk, without overlap."""
    return f"""list_transform([list_reduce(list_transform({parts}, lambda p: {{'chunks': []::VARCHAR[], 'text': {strip('p')}, 'words': len({words('p')})::INT}}), lambda a, x: CASE
      WHEN a.words = -1 THEN x
      WHEN {tokens('(a.words + x.words)')} + {cost} <= {size} THEN {{'chunks': a.chunks, 'text': a.text || chr(10) || chr(10) || x.text, 'words': (a.words + x.words)::INT}}
      ELSE {{'chunks': list_append(a.chunks, a.text), 'text': x.text, 'words': x.words}} END, {{'chunks': []::VARCHAR[], 'text': '', 'words': -1::INT}})], lambda f: CASE WHEN f.words = -1 THEN f.chunks ELSE list_append(f.chunks, f.text) END)[1]"""


def sections(size: int, overlap: int) -> str:
    """Chunks (doc_id, section, chunk in it, prefix, content) of the documents as Markdown sections, packed under their headings."""
    units = """(SELECT doc_id, section, prefix, i, text, greatest(1, {size} - cost) AS size, least({overlap}, greatest(1, {size} - cost) // 3) AS overlap, cost FROM (
      SELECT *, {cost} AS cost FROM (
        SELECT doc_id, 1 AS section, lang AS prefix, 1 AS i, 'Document ' || doc_id AS text FROM documents
        UNION ALL SELECT doc_id, 2, lang || ' > ' || source, u.i, l[u.i] FROM (SELECT doc_id, lang, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip}), lambda x: x <> '') AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i))))""".format(size=size, overlap=overlap, cost=count("prefix"), strip=strip("x"))
    parts = f"SELECT doc_id, section, prefix, cost, flatten(list(chunks ORDER BY i)) AS parts FROM ({split(units, 'doc_id, section, prefix, cost, i')}) GROUP BY doc_id, section, prefix, cost"
    packed = f"SELECT doc_id, section, prefix, {pack('parts', str(size), 'cost')} AS c FROM ({parts})"
    return f"SELECT doc_id, section, u.i AS place, prefix, prefix || chr(10) || chr(10) || c[u.i] AS content FROM ({packed}), unnest(range(1, len(c) + 1)) AS u(i)"
