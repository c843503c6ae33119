"""DuckDB SQL for the operators that SQL can express."""

EMBEDDING_GROUPS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
    label IS NOT NULL AND coalesce(len(embedding), 0) > 0
      AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), false)
      AND coalesce(list_bool_or(list_transform(embedding, lambda x: x <> 0)), false) AS ok
  FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE CASE WHEN a.ok AND b.ok THEN list_cosine_similarity(a.e, b.e) >= 0.93 ELSE false END
), reach(vec_id, r) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT reach.vec_id, l.b FROM reach JOIN l ON reach.r = l.a
)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = reach.vec_id) AS n_links, min(r) AS component_id, vec_id = min(r) AS kept
FROM reach GROUP BY vec_id
"""

# Blocks of 65,536 bytes, a period of 1,000 slots, weights from the square root of the sources' bytes.
PFAIR_MIX = """
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(strlen(text), 0) + 1 AS size, md5(doc_id::VARCHAR) AS spread FROM documents
), blocked AS (
  SELECT doc_id, source, size, (coalesce(sum(size) OVER (PARTITION BY source ORDER BY spread, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 65536)::BIGINT AS block
  FROM sized
), sources AS (
  SELECT source, sqrt(sum(size)) AS weight, ceil(sum(size) / 65536)::BIGINT AS blocks FROM sized GROUP BY source
), exact AS (
  SELECT *, weight * 1000 / sum(weight) OVER () AS part FROM sources
), shares AS (
  SELECT source, blocks, floor(part)::BIGINT + (row_number() OVER (ORDER BY part - floor(part) DESC, source)
    <= 1000 - sum(floor(part)) OVER ())::BIGINT AS share, row_number() OVER (ORDER BY source) AS n
  FROM exact
), lists AS (
  SELECT list(share ORDER BY n) AS share FROM shares
), plan(slot, done, pick, nth) AS (
  SELECT -1::BIGINT, list_transform(share, lambda x: 0::BIGINT), 0::BIGINT, 0::BIGINT FROM lists
  UNION ALL
  SELECT slot + 1, list_transform(done, lambda d, i: d + (i = picked)::BIGINT), picked, done[picked]
  FROM (
    SELECT slot, done, list_position(dates, list_min(dates))::BIGINT AS picked
    FROM (
      SELECT slot, done, list_transform(done, lambda d, i: CASE
        WHEN d < lists.share[i] AND d * 1000 // lists.share[i] <= slot + 1
        THEN ((d + 1) * 1000 + lists.share[i] - 1) // lists.share[i] ELSE 1000000000 END) AS dates
      FROM plan, lists WHERE slot < 999
    )
  )
), period AS (
  SELECT source, share, blocks, slot, nth FROM plan JOIN shares ON pick = n WHERE slot >= 0
), ends AS (
  SELECT min(blocks // share * 1000 + slot) AS horizon FROM period WHERE blocks % share = nth
)
SELECT doc_id, b.source, size, block, (block // share * 1000 + slot)::BIGINT AS slot,
  block // share * 1000 + slot < horizon AS in_mix
FROM blocked b JOIN period p ON b.source = p.source AND block % share = nth, ends
"""

# Terms: runs of ASCII letters and digits and of what lies beyond ASCII, A-Z as a-z.
BEST_POSITION = r"""
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tfs AS (
  SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY doc_id, term
), sizes AS (
  SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id
), whole AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM sizes
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tfs, whole GROUP BY term, docs
), item_terms AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term
), scores AS (
  SELECT item_id, doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length))))::BIGINT AS score
  FROM item_terms JOIN tfs USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), whole
  GROUP BY item_id, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""

# The checksum of each distinct word is worked out byte by byte from the usual table.
BISECTION = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS code
), lists AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), raw_words AS (
  SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM lists) GROUP BY word
), target_words AS (
  SELECT word, count(*) AS n FROM (
    SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark) GROUP BY word
), buckets AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(word)),
      lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c // 256, code[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM raw_words UNION SELECT word FROM target_words), crc
), raw_counts AS (
  SELECT bucket, sum(n)::BIGINT AS s FROM raw_words JOIN buckets USING (word) GROUP BY bucket
), target_counts AS (
  SELECT bucket, sum(n)::BIGINT AS t FROM target_words JOIN buckets USING (word) GROUP BY bucket
), totals AS (
  SELECT (SELECT coalesce(sum(s), 0)::BIGINT FROM raw_counts) AS s_all, (SELECT coalesce(sum(t), 0)::BIGINT FROM target_counts) AS t_all
), gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (s_all + 10000))::DOUBLE
    / ((coalesce(s, 0) + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS gain
  FROM raw_counts FULL JOIN target_counts USING (bucket), totals
), weights AS (
  SELECT doc_id, sum(gain)::BIGINT AS weight FROM (SELECT doc_id, unnest(words) AS word FROM lists)
  JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(len(words), 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE
      / 4294967296::DOUBLE)))::BIGINT AS score
  FROM lists LEFT JOIN weights USING (doc_id)
), ranked AS (
  SELECT *, n_features >= 20 AS able, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS nth,
    count(*) OVER (PARTITION BY n_features >= 20) AS n
  FROM scored
)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
  CASE WHEN able AND nth <= n * 10 // 100 THEN nth END::BIGINT AS rank
FROM ranked
"""

LINE_RUNS = r"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS nth
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT doc_id, line, nth, coalesce(doc_id <> keeper, false) AS lost FROM keyed LEFT JOIN repeated USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
