"""The registered queries as DuckDB SQL over the same tables, written independently."""

from __future__ import annotations

import re

# Shared views; a query gets the ones it names, in dependency order.
VIEWS = {
    "classes": "SELECT * FROM (VALUES (0::BIGINT,'normal'),(1,'scratch'),(2,'dent'),(3,'rust')) AS t(idx, class_name)",
    "classes5": "SELECT * FROM classes UNION ALL SELECT 4::BIGINT, 'chip'",
    "manifest": """
        SELECT doc_id, 'doc-' || doc_id AS image_id,
            CASE lang WHEN 'en' THEN 'normal' WHEN 'fr' THEN 'scratch' WHEN 'de' THEN 'dent' ELSE 'rust' END AS class_name,
            lang || '/' || doc_id || '.txt' AS file_path, sha256(text) AS checksum,
            CASE doc_id % 6 WHEN 0 THEN 'Undamaged' WHEN 1 THEN 'No Damage' ELSE source END AS source_object_label,
            source AS source_dataset, 'https://example.org/' || source || '/' || doc_id AS source_url,
            CASE WHEN doc_id % 97 = 0 THEN ' ' ELSE 'CC BY 4.0' END AS licence,
            source || '/' || (CASE WHEN doc_id % 20 < 5 THEN doc_id // 40 ELSE doc_id END) AS source_group,
            n_chars AS short_side
        FROM documents""",
    "source_manifest": """
        SELECT image_id, file_path, class_name, source_dataset AS source, licence AS license,
            CASE WHEN doc_id % 101 = 0 THEN checksum[2:] ELSE checksum END AS checksum,
            CASE WHEN doc_id % 211 = 0 THEN 'train' ELSE '' END AS dataset_split, source_group
        FROM manifest""",
    "records": """
        SELECT image_id, file_path, class_name, source_object_label AS original_label, source_dataset, source_url, licence, source_group,
            CASE doc_id % 7 WHEN 0 THEN 'rejected' WHEN 1 THEN ' Accepted ' ELSE 'accepted' END AS review_status,
            CASE WHEN doc_id % 2 = 0 THEN 'seen' ELSE '' END AS review_notes, short_side
        FROM manifest""",
    "ranked": """
        SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY md5('42:' || image_id), image_id) AS r,
            count(*) OVER (PARTITION BY class_name) AS n
        FROM manifest""",
    "trimmed": """
        SELECT * EXCLUDE (r, n), CASE WHEN r <= (n - n % 10) // 10 * 8 THEN 'train' WHEN r <= (n - n % 10) // 10 * 9 THEN 'validation' ELSE 'test' END AS dataset_split
        FROM ranked WHERE r <= n - n % 10""",
    "split": """
        SELECT * EXCLUDE (r, n), CASE WHEN r <= round(n * 0.8::DOUBLE) THEN 'train' WHEN r <= round(n * 0.8::DOUBLE) + round(n * 0.1::DOUBLE) THEN 'validation' ELSE 'test' END AS dataset_split
        FROM ranked""",
    "words": """
        SELECT doc_id, ('0x' || md5(w)[1:6])::BIGINT % 72 AS cell, count(*) AS c
        FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL""",
    "cells": """
        SELECT d.doc_id, i.i AS cell, coalesce(w.c, 0) AS c
        FROM documents d CROSS JOIN range(72) i(i) LEFT JOIN words w ON w.doc_id = d.doc_id AND w.cell = i.i""",
    "halves": """
        SELECT a.doc_id,
            sum(CASE WHEN b.c > a.c AND a.cell // 9 < 4 THEN 1::BIGINT << (a.cell // 9 * 8 + a.cell % 9)::INT ELSE 0 END)::BIGINT AS low,
            sum(CASE WHEN b.c > a.c AND a.cell // 9 >= 4 THEN 1::BIGINT << ((a.cell // 9 - 4) * 8 + a.cell % 9)::INT ELSE 0 END)::BIGINT AS high
        FROM cells a JOIN cells b ON a.doc_id = b.doc_id AND b.cell = a.cell + 1 WHERE a.cell % 9 < 8 GROUP BY 1""",
    "hashes": "SELECT doc_id, high, low, printf('%08x%08x', high, low) AS perceptual_hash FROM halves",
    "hashed": "SELECT m.*, h.high, h.low, h.perceptual_hash FROM manifest m JOIN hashes h USING (doc_id)",
    "hashed_split": "SELECT s.*, h.high, h.low, h.perceptual_hash FROM split s JOIN hashes h USING (doc_id)",
    "nodes": "SELECT perceptual_hash AS hash, any_value(high) AS high, any_value(low) AS low, count(*) AS n FROM hashed_split GROUP BY 1",
    "near": """
        SELECT a.hash AS hash_a, b.hash AS hash_b, (bit_count(xor(a.high, b.high)) + bit_count(xor(a.low, b.low)))::BIGINT AS distance, a.n AS n_a, b.n AS n_b
        FROM nodes a JOIN nodes b ON a.hash <= b.hash AND bit_count(xor(a.high, b.high)) + bit_count(xor(a.low, b.low)) <= 6
        WHERE a.hash < b.hash OR a.n > 1""",
    "cluster_links": "SELECT hash_a AS x, hash_b AS y FROM near UNION SELECT hash_b, hash_a FROM near",
    "cluster_reach": "SELECT x, y FROM cluster_links UNION SELECT r.x, l.y FROM cluster_reach r JOIN cluster_links l ON l.x = r.y",
    "cluster_members": """
        SELECT image_id, perceptual_hash, cluster_hash FROM hashed_split JOIN (SELECT x AS perceptual_hash, least(x, min(y)) AS cluster_hash FROM cluster_reach GROUP BY x) USING (perceptual_hash)""",
    "near_pairs": """
        SELECT n.hash_a, n.hash_b, n.distance, n.n_a, n.n_b, count(*) AS pair_count,
            sum((a.dataset_split <> b.dataset_split)::BIGINT)::BIGINT AS cross_split_pairs, sum((a.class_name <> b.class_name)::BIGINT)::BIGINT AS cross_class_pairs
        FROM near n JOIN hashed_split a ON a.perceptual_hash = n.hash_a JOIN hashed_split b ON b.perceptual_hash = n.hash_b
        WHERE n.hash_a < n.hash_b OR a.image_id < b.image_id GROUP BY ALL""",
    "pred": """
        SELECT event_id AS sample_index, ts, user_id % 4 AS true_idx, CASE WHEN event_type = 'error' THEN (user_id + 1) % 4 ELSE user_id % 4 END AS pred_idx,
            (event_id * 7919 % 1001)::DOUBLE / 1000 AS confidence,
            sha256(CASE WHEN user_id % 3 = 0 THEN 'new-' || user_id ELSE user_id::VARCHAR END) AS image_sha256
        FROM events""",
    "named": """
        SELECT p.*, a.class_name AS true_class, b.class_name AS predicted_class, true_idx = pred_idx AS is_correct
        FROM pred p JOIN classes a ON a.idx = true_idx JOIN classes b ON b.idx = pred_idx""",
    "feedback": """
        SELECT ts AS "timestamp", event_id AS seq, 'p-' || (event_id - event_id % 3) AS prediction_id,
            CASE WHEN event_id % 91 = 0 THEN '' ELSE 'img-' || user_id || '.png' END AS image_filename,
            CASE WHEN event_id % 59 = 0 THEN NULL WHEN event_id % 71 = 0 THEN upper(sha256(user_id::VARCHAR)) ELSE sha256(user_id::VARCHAR) END AS image_sha256,
            CASE WHEN event_id % 29 = 0 THEN 'unknown' WHEN event_id % 31 = 0 THEN 'paint' ELSE a.class_name END AS predicted_class,
            (event_id * 7919 % 1051)::DOUBLE / 1000 AS confidence, event_type <> 'error' AS is_correct,
            CASE WHEN event_type = 'error' AND event_id % 3 <> 0 THEN CASE WHEN event_id % 67 = 0 THEN 'paint' ELSE b.class_name END
                 WHEN event_type <> 'error' AND event_id % 73 = 0 THEN 'normal' END AS corrected_class,
            CASE WHEN event_id % 83 = 0 THEN repeat('x', 501) WHEN event_id % 2 = 0 THEN 'ok' END AS comment
        FROM events JOIN classes a ON a.idx = user_id % 4 JOIN classes b ON b.idx = (user_id + 1) % 4""",
    "checked": """
        SELECT *, list_filter([
            CASE WHEN prediction_id = '' THEN 'empty_prediction_id' END, CASE WHEN image_filename = '' THEN 'empty_image_filename' END,
            CASE WHEN NOT regexp_full_match(image_sha256, '[0-9a-f]{64}') THEN 'image_sha256_format' END,
            CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence_range' END,
            CASE WHEN NOT is_correct AND corrected_class IS NULL THEN 'correction_required' END,
            CASE WHEN is_correct AND corrected_class IS NOT NULL THEN 'correction_forbidden' END,
            CASE WHEN length(comment) > 500 THEN 'comment_too_long' END,
            CASE WHEN predicted_class NOT IN ('normal','scratch','dent','rust','unknown') THEN 'predicted_class_unknown' END,
            CASE WHEN corrected_class NOT IN ('normal','scratch','dent','rust') THEN 'corrected_class_unknown' END
        ], lambda e: e IS NOT NULL) AS errors FROM feedback""",
    "labelled": """
        SELECT *, CASE WHEN is_correct THEN predicted_class ELSE corrected_class END AS label FROM feedback""",
    "latest": """
        SELECT image_sha256, label AS feedback_class FROM (
            SELECT *, row_number() OVER (PARTITION BY image_sha256 ORDER BY "timestamp" DESC, seq DESC) AS r
            FROM labelled WHERE label IN ('normal','scratch','dent','rust') AND image_sha256 <> '') WHERE r = 1""",
    "overridden": """
        SELECT p.sample_index, p.predicted_class AS most_likely_class, p.confidence < 0.65 AS model_review,
            CASE WHEN p.confidence < 0.65 THEN 'unknown' ELSE p.predicted_class END AS model_class, l.feedback_class,
            coalesce(l.feedback_class <> CASE WHEN p.confidence < 0.65 THEN 'unknown' ELSE p.predicted_class END, false) AS feedback_applied
        FROM named p LEFT JOIN latest l USING (image_sha256)""",
    "answered": """
        SELECT sample_index, most_likely_class, coalesce(feedback_class, model_class) AS predicted_class, feedback_applied,
            model_review AND NOT feedback_applied AS requires_manual_review,
            CASE WHEN feedback_applied THEN 'Saved human correction applied; the model''s own result was ''' || most_likely_class || '''.'
                 WHEN model_review THEN 'Manual review is required.' ELSE 'Predicted class: ' || most_likely_class END AS message
        FROM overridden""",
    "uploads": """
        SELECT event_id, ['photo.JPG', 'a.png', 'b.gif', '', 'dir/c.jpeg', 'noext', '.png'][event_id % 7 + 1] AS filename,
            ['image/jpeg', 'image/png', ' IMAGE/PNG ', 'text/plain'][user_id % 4 + 1] AS content_type,
            CASE WHEN event_id % 11 = 0 THEN 0 WHEN event_id % 13 = 0 THEN 10485761 ELSE round(value * 100)::BIGINT END AS size_bytes,
            event_id % 17 <> 0 AS decodable, event_id % 101 <> 0 AS model_available
        FROM events""",
    "admitted": """
        SELECT *, filename <> '' AND size_bytes > 0 AND size_bytes <= 10485760 AND
            CASE lower(trim(content_type)) WHEN 'image/jpeg' THEN filename IN ('photo.JPG', 'dir/c.jpeg') WHEN 'image/png' THEN filename = 'a.png' ELSE false END AS ok
        FROM uploads""",
    "log": "SELECT 'p-' || event_id AS prediction_id, sha256('img-' || user_id) AS recorded FROM events WHERE event_type = 'view'",
    "items": """
        SELECT row_number() OVER () AS id, l_orderkey AS k, l_partkey AS p,
            'set/ann/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '.jpg.json' AS annotation_path,
            'set/img/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '.jpg' AS image_path,
            CASE WHEN l_orderkey % 10 = 0 THEN 'normal' ELSE 'damage' END AS kind,
            CASE WHEN l_orderkey % 53 = 0 OR l_orderkey % 101 = 0 THEN NULL WHEN l_orderkey % 50 = 0 THEN 95 ELSE 800 END AS width,
            CASE WHEN l_orderkey % 53 = 0 OR l_orderkey % 101 = 0 THEN NULL ELSE 600 END AS height, *
        FROM lineitem""",
    "objects": """
        SELECT id, annotation_path, image_path, kind, width, height, 1 AS o,
            CASE WHEN k % 10 = 0 THEN 'Front-Door' ELSE CASE l_returnflag WHEN 'R' THEN 'Scratch' WHEN 'A' THEN 'Dent' ELSE 'Corrosion' END END AS title,
            (p % 600)::DOUBLE AS x, (l_suppkey % 400)::DOUBLE AS y, (p % 600)::DOUBLE + (20 + l_quantity * 3) AS x2, (l_suppkey % 400)::DOUBLE + (20 + l_tax * 1000) AS y2
        FROM items WHERE k % 101 <> 0
        UNION ALL
        SELECT id, annotation_path, image_path, kind, width, height, 2,
            CASE WHEN k % 10 = 0 THEN 'hood' ELSE CASE l_linestatus WHEN 'F' THEN 'Dent' ELSE 'Scratch' END END,
            (l_suppkey % 500)::DOUBLE, (p % 300)::DOUBLE, (l_suppkey % 500 + 30 + l_linenumber * 20)::DOUBLE, (p % 300 + 40 + l_linenumber * 10)::DOUBLE
        FROM items WHERE k % 101 <> 0
        UNION ALL
        SELECT id, annotation_path, image_path, kind, width, height, 3, 'Broken part',
            ((p + l_suppkey) % 700)::DOUBLE, (k % 300)::DOUBLE, ((p + l_suppkey) % 700 + 50)::DOUBLE, (k % 300 + 60)::DOUBLE
        FROM items WHERE k % 101 <> 0 AND p % 4 = 3""",
    "worst_overlaps": """
        SELECT a.id, a.o, max(greatest(0.0, least(a.x2, b.x2) - greatest(a.x, b.x)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y, b.y))
            / ((a.x2 - a.x) * (a.y2 - a.y))) AS worst
        FROM objects a JOIN objects b ON a.id = b.id AND lower(a.title) <> lower(b.title) GROUP BY ALL""",
    "scored": """
        SELECT a.*, (a.x2 - a.x) * (a.y2 - a.y) AS area,
            CASE WHEN a.kind = 'damage' THEN coalesce(v.worst, 0.0) ELSE 0.0 END AS overlap,
            CASE WHEN a.kind = 'normal' THEN CASE WHEN lower(a.title) IN ('front-door', 'hood') THEN 'normal' END
                 ELSE CASE lower(a.title) WHEN 'dent' THEN 'dent' WHEN 'scratch' THEN 'scratch' WHEN 'corrosion' THEN 'rust' END END AS class_name
        FROM objects a LEFT JOIN worst_overlaps v ON v.id = a.id AND v.o = a.o
        WHERE a.width >= 96 AND a.height >= 96""",
    "chosen": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY area DESC, o) AS r FROM scored WHERE class_name IS NOT NULL AND overlap <= 0.10) WHERE r = 1""",
    "sided": "SELECT *, least(greatest(greatest(x2 - x, y2 - y) * 1.4::DOUBLE, 96.0::DOUBLE), width::DOUBLE, height::DOUBLE) AS side FROM chosen",
    "cornered": """
        SELECT *, greatest(0.0::DOUBLE, least((x + x2) / 2.0::DOUBLE - side / 2.0::DOUBLE, width - side)) AS l,
            greatest(0.0::DOUBLE, least((y + y2) / 2.0::DOUBLE - side / 2.0::DOUBLE, height - side)) AS t FROM sided""",
    "crops": """
        SELECT * FROM (SELECT *, round_even(l, 0)::INT AS cl, round_even(t, 0)::INT AS ct, round_even(l + side, 0)::INT AS cr, round_even(t + side, 0)::INT AS cb FROM cornered)
        WHERE cr - cl >= 96 AND cb - ct >= 96""",
    "defects": "SELECT 'Car panel' AS object_type, 'sup-' || s_suppkey AS class_name, s_name AS display_name, s_suppkey FROM supplier",
    "steps": """
        SELECT class_name, p AS position, 'step ' || p || ' for ' || display_name AS instruction, class_name || '-step-0' || p AS step_id
        FROM (SELECT class_name, display_name, unnest(range(1, 3 + s_suppkey % 2)) AS p FROM defects)""",
    "attributes": """
        SELECT p_partkey, 'P' || p_partkey AS part_id, p_name AS part_name, p_retailprice AS mock_price, 'INR' AS currency, (p_size % 15)::BIGINT AS fake_stock_quantity,
            CASE WHEN p_size % 15 = 0 THEN 'out_of_stock' WHEN p_size % 15 < 5 THEN 'low_stock' ELSE 'in_stock' END AS availability_status,
            strftime(m, '%Y-%m-%d') AS last_updated
        FROM part JOIN (SELECT l_partkey, max(l_shipdate) AS m FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""",
    "pairs": "SELECT DISTINCT 'sup-' || l_suppkey AS class_name, l_partkey AS p_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part)",
    "panel_parts": "SELECT class_name, count(*) AS part_count FROM nation JOIN classes ON idx = n_nationkey % 4 WHERE n_nationkey % 4 > 0 GROUP BY 1",
    "panel_steps": "SELECT class_name, count(*) AS step_count FROM region JOIN classes ON idx = 1 + r_regionkey % 3 GROUP BY 1",
    "panel": """
        SELECT class_name, upper(class_name[1]) || class_name[2:] AS display_name, coalesce(step_count, 0) AS step_count, coalesce(part_count, 0) AS part_count,
            CASE WHEN class_name IN ('scratch', 'dent') THEN 'neo4j' ELSE 'static_catalog_fallback' END AS knowledge_source
        FROM (SELECT DISTINCT class_name FROM nation JOIN classes ON idx = n_nationkey % 4) LEFT JOIN panel_parts USING (class_name) LEFT JOIN panel_steps USING (class_name)
        WHERE class_name <> 'rust'""",
    "cells5": """
        SELECT a.idx AS true_idx, b.idx AS pred_idx, a.class_name AS true_class, b.class_name AS predicted_class, count(p.sample_index) AS n
        FROM classes5 a CROSS JOIN classes5 b LEFT JOIN pred p ON p.true_idx = a.idx AND p.pred_idx = b.idx GROUP BY ALL""",
    "ratios": """
        SELECT idx, class_name, (SELECT coalesce(sum(n), 0) FROM cells5 WHERE true_idx = idx)::BIGINT AS support,
            (SELECT coalesce(sum(n), 0) FROM cells5 WHERE pred_idx = idx) AS predicted, (SELECT sum(n) FROM cells5 WHERE true_idx = idx AND pred_idx = idx) AS hits
        FROM classes5""",
    "metrics": """
        SELECT idx, class_name, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall,
            CASE WHEN predicted + support > 0 THEN 2 * hits / (predicted + support) ELSE 0 END AS f1_score, support FROM ratios""",
    "results3": "SELECT sample_index AS filename, true_class AS expected_class, CASE WHEN sample_index % 3 = 0 THEN 'unknown' ELSE predicted_class END AS predicted_class FROM named",
    "results7": "SELECT sample_index AS filename, true_class AS expected_class, CASE WHEN sample_index % 7 = 0 THEN 'unknown' ELSE predicted_class END AS predicted_class FROM named",
    "thresholds": "SELECT (i / 100)::DOUBLE AS t FROM range(25, 91, 5) r(i)",
    "analysis": """
        SELECT t AS confidence_threshold, count(*) AS sample_count, count(*) FILTER (confidence >= t) AS accepted_count, count(*) FILTER (confidence < t) AS rejected_count,
            count(*) FILTER (confidence >= t AND true_idx <> pred_idx) AS accepted_error_count,
            round(avg((confidence >= t)::INT), 6) AS coverage, round(avg((confidence < t)::INT), 6) AS manual_review_rate,
            round(avg((true_idx = pred_idx)::INT) FILTER (confidence >= t), 6) AS accepted_accuracy,
            count(*) FILTER (confidence < t AND true_idx = 0) AS rejected_normal, count(*) FILTER (confidence < t AND true_idx = 1) AS rejected_scratch,
            count(*) FILTER (confidence < t AND true_idx = 2) AS rejected_dent, count(*) FILTER (confidence < t AND true_idx = 3) AS rejected_rust,
            round(avg(confidence) FILTER (true_idx = pred_idx), 6) AS mean_confidence_correct, round(avg(confidence) FILTER (true_idx <> pred_idx), 6) AS mean_confidence_incorrect
        FROM pred CROSS JOIN thresholds GROUP BY t""",
    "runs": """
        SELECT conv_id AS run_id, turn + 1 AS epoch, CASE WHEN turn < 3 THEN 'head' ELSE 'all' END AS stage, (length(text) % 97)::DOUBLE / 100 AS loss FROM conversations""",
    "blocks": """
        SELECT vec_id, [list_sum(list_transform(embedding[16 * k + 1:16 * k + 16], lambda x: x::DOUBLE)) FOR k IN range(4)] AS z FROM embeddings""",
    "head_rows": """
        SELECT vec_id, y, x, validation, CASE WHEN NOT validation THEN count(*) FILTER (NOT validation) OVER () / (4 * count(*) FILTER (NOT validation) OVER (PARTITION BY y)) END AS weight
        FROM (SELECT vec_id, label % 4 AS y, list_concat([1.0::DOUBLE], embedding::DOUBLE[]) AS x, ('0x' || md5(vec_id::VARCHAR)[1:8])::BIGINT % 5 = 0 AS validation FROM embeddings)""",
    "head_steps": """
        SELECT 0 AS i, list_transform(range(4 * max(len(x))), lambda j: 0.0::DOUBLE) AS w, list_transform(range(4 * max(len(x))), lambda j: 0.0::DOUBLE) AS v FROM head_rows
        UNION ALL
        SELECT i + 1, list_transform(w, lambda a, k: a - 0.5::DOUBLE * v[k]), v FROM (
            SELECT i, any_value(w) AS w, list(0.9::DOUBLE * v[1 + j] + (g / (n * 1000000.0::DOUBLE) + CASE WHEN j % width = 0 THEN 0.0::DOUBLE ELSE 0.001::DOUBLE END * w[1 + j]) ORDER BY j) AS v
            FROM (
                SELECT i, j, any_value(w) AS w, any_value(v) AS v, any_value(width) AS width, count(*) AS n,
                    sum(floor((weight * (p[1 + j // width] - CASE WHEN y = j // width THEN 1 ELSE 0 END)) * x[1 + j % width] * 1000000 + 0.5)::HUGEINT)::DOUBLE AS g
                FROM (
                    SELECT *, list_transform(e, lambda a: a / list_sum(e)) AS p, unnest(range(4 * width)) AS j FROM (
                        SELECT *, list_transform(z, lambda a: exp(a - list_max(z))) AS e FROM (
                            SELECT s.i, s.w, s.v, y, x, weight, len(x) AS width, [list_dot_product(s.w[1 + k * len(x):(k + 1) * len(x)], x) FOR k IN range(4)] AS z
                            FROM head_steps s, head_rows WHERE s.i < 30 AND NOT validation)))
                GROUP BY i, j)
            GROUP BY i)""",
    "head_pred": """
        SELECT vec_id, validation, y::BIGINT AS true_idx, list_position(z, list_max(z)) - 1::BIGINT AS pred_idx, 1 / list_sum(list_transform(z, lambda a: exp(a - list_max(z)))) AS confidence
        FROM (SELECT *, [list_dot_product(w[1 + k * len(x):(k + 1) * len(x)], x) FOR k IN range(4)] AS z FROM head_rows, (SELECT w FROM head_steps WHERE i = 30))""",
    "heldout": """
        SELECT *, image_id AS filename, class_name AS expected_class, CASE WHEN doc_id % 130 = 0 THEN 'no' ELSE 'Yes' END AS excluded,
            CASE WHEN doc_id % 170 = 0 THEN '' ELSE 'yes' END AS frozen FROM hashed WHERE doc_id % 10 = 0""",
    "development": "SELECT * FROM hashed WHERE doc_id % 10 <> 0",
    "decisions": """
        SELECT DISTINCT CASE lang WHEN 'en' THEN 'normal' WHEN 'fr' THEN 'scratch' WHEN 'de' THEN 'dent' ELSE 'rust' END AS class_name, doc_id // 3 AS accepted_index
        FROM documents WHERE doc_id // 3 % 2 = 0""",
    "placed": "SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY file_path) - 1 AS record_index FROM records",
    "manifest_rules": """
        SELECT 'blank_license' AS rule, image_id AS subject FROM source_manifest WHERE trim(license) = ''
        UNION ALL SELECT 'checksum_format', image_id FROM source_manifest WHERE NOT regexp_full_match(checksum, '[0-9a-fA-F]{64}')
        UNION ALL SELECT 'assigned_split', image_id FROM source_manifest WHERE trim(dataset_split) <> ''
        UNION ALL SELECT 'duplicate_checksum', checksum FROM source_manifest GROUP BY checksum HAVING count(*) > 1
        UNION ALL SELECT 'duplicate_source_group', source_group FROM source_manifest GROUP BY source_group HAVING count(*) > 1""",
}

BODIES = {
    "scan_manifest": "SELECT image_id, file_path, class_name, checksum FROM manifest",
    "manifest_violations": "SELECT rule, subject FROM manifest_rules",
    "violation_counts": "SELECT rule, count(*) AS violation_count FROM manifest_rules GROUP BY 1",
    "union_splits": "SELECT image_id, class_name, CASE WHEN dataset_split <> 'test' THEN source_object_label END AS source_object_label, dataset_split AS audit_split FROM split",
    "annotation_objects": "SELECT annotation_path, title, lower(title) AS label, x AS \"left\", y AS top, x2 AS \"right\", y2 AS bottom FROM objects",
    "content_checksum": "SELECT doc_id, sha256(text) AS actual_checksum, strlen(text) AS length FROM documents",
    "image_decode_audit": """
        SELECT 'doc-' || doc_id AS path, doc_id % 13 <> 0 AS decodable, CASE WHEN doc_id % 13 <> 0 THEN 10::BIGINT END AS width,
            CASE WHEN doc_id % 13 <> 0 THEN (strlen(text) + 29) // 30 END AS height, CASE WHEN doc_id % 13 <> 0 THEN least(10, (strlen(text) + 29) // 30) END AS short_side FROM documents""",
    "folder_class_coverage": """
        SELECT coalesce(e.c, o.c) AS class_name, e.c IS NOT NULL AS expected, o.c IS NOT NULL AS observed, coalesce(o.n, 0) AS record_count
        FROM (SELECT unnest(['en', 'fr', 'de', 'it']) AS c) e FULL JOIN (SELECT lang AS c, count(*) AS n FROM documents GROUP BY 1) o ON e.c = o.c""",
    "class_table": "SELECT idx, class_name, min(doc_id) AS first_doc FROM classes JOIN manifest USING (class_name) GROUP BY ALL",
    "catalog_violations": """
        SELECT p_partkey::VARCHAR AS subject, unnest(list_filter([
            CASE WHEN p_partkey % 41 = 0 THEN 'object_type_empty' END, CASE WHEN p_partkey % 43 = 0 THEN 'threshold_range' END,
            CASE WHEN p_partkey % 37 = 0 OR p_type = p_brand THEN 'duplicate_class' END, CASE WHEN p_partkey % 47 = 0 THEN 'display_name_empty' END,
            CASE WHEN p_partkey % 50 = 0 THEN 'price_negative' END, CASE WHEN p_partkey % 77 = 0 THEN 'currency_length' END,
            CASE WHEN p_partkey % 61 = 0 AND p_size > 0 THEN 'stock_negative' END], lambda r: r IS NOT NULL)) AS rule FROM part""",
    "licensed_candidates": """
        SELECT page_id, 'commons-' || page_id AS source_group, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
            regexp_extract(html, '<html lang="([^"]*)"', 1) || ' (' || regexp_extract(url, '^(https://[^/]+)', 1) || ')' AS licence,
            trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&amp;?', '&', 'g'), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS artist
        FROM pages WHERE page_id % 9 <> 0 AND url LIKE 'https://_%' AND regexp_extract(html, '<html lang="([^"]*)"', 1) <> '' ORDER BY page_id LIMIT 100""",
    "split_fingerprint": """
        SELECT n AS row_count, sha256(n || ':' || s[1] || ':' || s[2] || ':' || s[3] || ':' || s[4] || ':' || s[5] || ':' || s[6] || ':' || s[7] || ':' || s[8]) AS fingerprint FROM (
            SELECT count(*) AS n, [%WORDS%] AS s FROM (SELECT sha256(%ROW%) AS h FROM split WHERE dataset_split = 'test'))"""
        .replace("%ROW%", "length(image_id) || ':' || image_id || '|' || length(class_name) || ':' || class_name || '|' || length(checksum) || ':' || checksum")
        .replace("%WORDS%", ", ".join(f"sum(('0x' || h[{8 * i + 1}:{8 * i + 8}])::BIGINT)::VARCHAR" for i in range(8))),
    "safe_destination": """
        SELECT doc_id, dataset_split || '/' || class_name || '/doc_' || doc_id || '_' || class_name || '___' || doc_id || '.txt' AS destination FROM split""",
    "feedback_append": "SELECT prediction_id, predicted_class, is_correct, corrected_class FROM checked WHERE len(errors) = 0",
    "feedback_upgrade": """
        SELECT seq::VARCHAR AS "timestamp", prediction_id, image_filename, '' AS image_sha256, predicted_class, '' AS confidence, is_correct::VARCHAR AS is_correct,
            coalesce(corrected_class, '') AS corrected_class, coalesce(comment, '') AS comment FROM feedback""",
    "normalize_required": """
        SELECT image_id, file_path, class_name, CASE WHEN length(image_id) % 2 = 0 THEN source ELSE '' END AS source, trim(license) AS license, checksum FROM source_manifest""",
    "traceability_violations": """
        SELECT rule, count(*) AS violation_count FROM (
            SELECT unnest(list_filter([CASE WHEN trim(licence) = '' THEN 'blank_licence' END, CASE WHEN doc_id % 103 = 0 THEN 'blank_perceptual_hash' END,
                CASE WHEN doc_id % 107 = 0 THEN 'checksum_format' END, CASE WHEN doc_id % 103 = 0 THEN 'perceptual_hash_format' END], lambda r: r IS NOT NULL)) AS rule FROM split)
        GROUP BY 1""",
    "accepted_records": "SELECT file_path, class_name, review_status FROM records WHERE lower(trim(review_status)) = 'accepted'",
    "accepted_violations": """
        WITH a AS (SELECT * FROM records WHERE lower(trim(review_status)) = 'accepted')
        SELECT 'blank_licence' AS rule, file_path AS subject FROM a WHERE trim(licence) = ''
        UNION ALL SELECT 'unsupported_class', file_path FROM a WHERE class_name NOT IN ('normal', 'scratch', 'dent', 'chip')
        UNION ALL SELECT 'uncovered_class', 'chip'
        UNION ALL SELECT 'duplicate_source_group', source_group FROM a GROUP BY source_group HAVING count(*) > 1""",
    "misclassified": "SELECT sample_index, true_class, predicted_class, confidence FROM named WHERE NOT is_correct",
    "manual_review": "SELECT sample_index, confidence, confidence < 0.65 AS requires_manual_review, is_correct FROM named",
    "upload_admission": "SELECT event_id, ok AS admitted FROM admitted",
    "upload_status": """
        SELECT event_id, (CASE WHEN NOT model_available THEN 503 WHEN lower(content_type) NOT IN ('image/jpeg', 'image/png') THEN 415
            WHEN size_bytes > 10485760 THEN 413 WHEN NOT ok OR NOT decodable THEN 400 ELSE 200 END)::BIGINT AS status FROM admitted""",
    "feedback_valid": "SELECT seq, prediction_id, predicted_class, corrected_class FROM checked WHERE len(errors) = 0",
    "feedback_rejected": "SELECT seq, array_to_string(list_sort(errors), ',') AS errors FROM checked WHERE len(errors) > 0",
    "annotation_admission": """
        SELECT annotation_path, CASE WHEN width IS NULL OR height IS NULL THEN 'missing_size' WHEN least(width, height) < 96 THEN 'image_too_small' ELSE 'admitted' END AS status FROM items""",
    "label_map": """
        SELECT lower(title) AS label, count(*) AS n, CASE lower(title) WHEN 'dent' THEN 'dent' WHEN 'scratch' THEN 'scratch' WHEN 'corrosion' THEN 'rust' END AS class_name
        FROM objects WHERE kind = 'damage' GROUP BY 1""",
    "demo_manifest_violations": """
        SELECT 'not_excluded' AS rule, filename AS subject FROM heldout WHERE lower(excluded) <> 'yes'
        UNION ALL SELECT 'not_frozen_before_inference', filename FROM heldout WHERE lower(frozen) <> 'yes'
        UNION ALL SELECT 'class_count', class_name FROM classes c WHERE (SELECT count(*) FROM heldout h WHERE h.expected_class = c.class_name) <> 10""",
    "class_distribution": """
        SELECT coalesce(e.c, o.c) AS class_name, e.c IS NOT NULL AS expected, o.c IS NOT NULL AS observed, coalesce(o.n, 0) AS record_count
        FROM (SELECT unnest(['normal', 'scratch', 'dent', 'chip']) AS c) e FULL JOIN (SELECT class_name AS c, count(*) AS n FROM manifest GROUP BY 1) o ON e.c = o.c""",
    "split_label_violations": "SELECT image_id, dataset_split, 'train' AS found_in FROM split WHERE doc_id % 51 = 0 AND dataset_split <> 'train'",
    "graph_completeness": """
        WITH s AS (SELECT class_name, count(*) AS s FROM steps GROUP BY 1), p AS (SELECT class_name, count(*) AS p FROM pairs GROUP BY 1),
        e AS (SELECT 'sup-' || unnest([1, 2, 3, 4, 5, 0]) AS class_name),
        u AS (SELECT class_name FROM e UNION SELECT class_name FROM defects)
        SELECT class_name, coalesce(s, 0) AS step_count, coalesce(p, 0) AS part_count,
            CASE WHEN class_name NOT IN (FROM e) THEN 'unexpected_class' WHEN class_name NOT IN (SELECT class_name FROM defects) THEN 'missing_class'
                 WHEN class_name = 'sup-2' AND coalesce(s, 0) + coalesce(p, 0) > 0 THEN 'normal_has_guidance'
                 WHEN class_name <> 'sup-2' AND (coalesce(s, 0) NOT BETWEEN 2 AND 3 OR coalesce(p, 0) < 1) THEN 'incomplete_guidance' ELSE 'ok' END AS status
        FROM u LEFT JOIN s USING (class_name) LEFT JOIN p USING (class_name)""",
    "digest_mismatches": """
        SELECT image_id, file_path, error FROM (SELECT image_id, file_path,
            CASE WHEN doc_id % 40 = 0 THEN 'missing' WHEN doc_id % 45 = 0 THEN 'undecodable' WHEN doc_id % 33 = 0 THEN 'checksum_mismatch' END AS error FROM manifest) WHERE error IS NOT NULL""",
    "prediction_violations": """
        SELECT 'predicted_label_range' AS rule, sample_index::VARCHAR AS subject FROM pred WHERE sample_index % 89 = 0
        UNION ALL SELECT 'confidence_range', sample_index::VARCHAR FROM pred WHERE sample_index % 97 = 0 AND confidence + 1 > 1""",
    "cross_split_duplicates": """
        SELECT identity, count(DISTINCT dataset_split) AS split_count FROM (
            SELECT 'checksum:' || checksum AS identity, dataset_split FROM split UNION ALL SELECT 'image_id:' || image_id, dataset_split FROM split
            UNION ALL SELECT 'file_path:' || lower(file_path), dataset_split FROM split UNION ALL SELECT 'source_group:' || source_group, dataset_split FROM split)
        GROUP BY 1 HAVING count(DISTINCT dataset_split) > 1""",
    "near_dup_cross_split": """
        WITH g AS (SELECT perceptual_hash AS hash, any_value(high) AS high, any_value(low) AS low, dataset_split, CASE dataset_split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS i,
            count(*) AS n, min(image_id) AS first_id FROM hashed_split GROUP BY ALL),
        j AS (SELECT a.*, b.hash AS hash_b, b.dataset_split AS split_b, b.n AS n_b, b.first_id AS id_b, bit_count(xor(a.high, b.high)) + bit_count(xor(a.low, b.low)) AS dist
            FROM g a JOIN g b ON a.i < b.i AND bit_count(xor(a.high, b.high)) + bit_count(xor(a.low, b.low)) <= 6)
        SELECT dataset_split || ':' || first_id || '<->' || split_b || ':' || id_b || ' (dHash distance ' || dist || ')' AS line, hash AS first_hash, hash_b AS second_hash,
            n AS first_count, n_b AS second_count, n * n_b AS pair_count FROM j""",
    "near_dup_all": "SELECT hash_a, hash_b, distance, n_a, n_b, pair_count, cross_split_pairs, cross_class_pairs FROM near_pairs",
    "near_dup_members": """
        SELECT perceptual_hash, image_id, sum(m)::BIGINT AS partner_count, min(distance) AS nearest_distance FROM hashed_split JOIN (
            SELECT hash_a AS perceptual_hash, distance, CASE WHEN hash_a = hash_b THEN n_b - 1 ELSE n_b END AS m FROM near
            UNION ALL SELECT hash_b, distance, n_a FROM near WHERE hash_a <> hash_b) USING (perceptual_hash) GROUP BY ALL""",
    "near_dup_clusters": "SELECT image_id, perceptual_hash, cluster_hash, count(*) OVER (PARTITION BY cluster_hash) AS cluster_size FROM cluster_members",
    "near_dup_all_refined": "SELECT hash_a, hash_b, distance, n_a, n_b, pair_count, cross_split_pairs, cross_class_pairs FROM near_pairs",
    "csv_rejects": """
        WITH e AS (SELECT event_id::VARCHAR AS id, event_id || ',' || user_id AS head, event_type AS t, event_id % 101 = 0 AS short, event_id % 107 = 0 AS unclosed, event_id % 103 = 0 AS long FROM events),
        l AS (SELECT *, head || CASE WHEN short THEN '' WHEN unclosed THEN ',' || t || ',"never closed' ELSE ',' || t || ',"said ""' || t || '"", twice"' END || CASE WHEN long THEN ',extra,' ELSE '' END AS line,
            CASE WHEN unclosed AND NOT short THEN 'unclosed_quote' WHEN short AND NOT long THEN 'short_row' WHEN long AND NOT short THEN 'long_row' END AS reason FROM e)
        SELECT CASE WHEN reason IS NULL THEN id END AS event_id, CASE WHEN reason IS NULL THEN CASE WHEN short THEN NULL ELSE 'said "' || t || '", twice' END END AS comment,
            CASE WHEN reason IS NOT NULL THEN line END AS record, reason FROM l""",
    "incremental_digests": """
        SELECT lang, source, doc_id // 1000 AS chunk, octet_length(encode(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10)))::BIGINT AS length,
            sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10)) AS actual_checksum, doc_id // 1000 % 2 = 1 AS fresh FROM documents GROUP BY ALL""",
    "near_dup_two_tables": """
        WITH g AS (SELECT perceptual_hash AS hash, any_value(high) AS high, any_value(low) AS low, count(*) AS n, min(image_id) AS first_id FROM heldout GROUP BY 1),
        e AS (SELECT perceptual_hash AS hash, any_value(high) AS high, any_value(low) AS low, count(*) AS n, min(image_id) AS first_id FROM development GROUP BY 1)
        SELECT 'heldout:' || a.first_id || '<->development:' || b.first_id || ' (dHash distance ' || (bit_count(xor(a.high, b.high)) + bit_count(xor(a.low, b.low))) || ')' AS line,
            a.hash AS first_hash, b.hash AS second_hash, a.n * b.n AS pair_count
        FROM g a JOIN e b ON bit_count(xor(a.high, b.high)) + bit_count(xor(a.low, b.low)) <= 6""",
    "heldout_leakage": """
        SELECT 'shared_source_group' AS rule, filename AS subject, source_group AS value FROM heldout WHERE source_group IN (SELECT source_group FROM development)
        UNION ALL SELECT 'shared_checksum', filename, checksum FROM heldout WHERE checksum IN (SELECT checksum FROM development)""",
    "heldout_intersect": "SELECT checksum FROM manifest WHERE doc_id % 10 = 0 INTERSECT SELECT checksum FROM manifest WHERE doc_id % 10 <> 0",
    "exclude_used_groups": """
        SELECT image_id, source_group FROM records WHERE source_group NOT IN (SELECT source_group FROM manifest WHERE doc_id % 10 = 0)
            AND source_group NOT IN (SELECT source_group FROM split WHERE dataset_split = 'test')""",
    "duplicate_keys": """
        SELECT 'checksum' AS key_column, checksum AS key_value, count(*) AS row_count FROM manifest GROUP BY ALL HAVING count(*) > 1
        UNION ALL SELECT 'source_group', source_group, count(*) FROM manifest GROUP BY ALL HAVING count(*) > 1""",
    "pick_listed": """
        SELECT image_id, class_name, true AS found FROM manifest WHERE doc_id IN (SELECT doc_id FROM labels WHERE doc_id % 10 <> 3)
        UNION ALL SELECT DISTINCT 'gone-' || doc_id, NULL, false FROM labels WHERE doc_id % 10 = 3""",
    "hash_violations": """
        SELECT image_id, CASE WHEN doc_id % 61 = 0 THEN ' ' ELSE 'xyz' END AS perceptual_hash, CASE WHEN doc_id % 61 = 0 THEN 'blank_hash' ELSE 'invalid_hash' END AS rule
        FROM manifest WHERE doc_id % 61 = 0 OR doc_id % 67 = 0""",
    "graph_nodes": """
        SELECT 'ObjectType' AS label, 'Car panel' AS node_key, 'Car panel' AS text UNION ALL SELECT 'Defect', class_name, display_name FROM defects
        UNION ALL SELECT 'RepairStep', step_id, instruction FROM steps UNION ALL SELECT 'Part', part_id, part_name FROM attributes
        UNION ALL SELECT 'InventoryRecord', part_id, availability_status FROM attributes""",
    "graph_edges": """
        SELECT 'CAN_HAVE' AS label, object_type AS from_key, class_name AS to_key, NULL::BIGINT AS position FROM defects
        UNION ALL SELECT 'HAS_REPAIR_STEP', class_name, step_id, position FROM steps
        UNION ALL SELECT 'MAY_REQUIRE', class_name, 'P' || p_partkey, NULL FROM pairs UNION ALL SELECT 'HAS_INVENTORY', part_id, part_id, NULL FROM attributes""",
    "graph_upsert": """
        WITH n AS (SELECT 'P' || (l_partkey * 2) AS inventory_id, l_extendedprice AS mock_price, l_quantity::INT AS stock, l_orderkey AS seq FROM lineitem),
        r AS (SELECT *, row_number() OVER (PARTITION BY inventory_id ORDER BY seq DESC, mock_price DESC, stock DESC) AS r FROM n)
        SELECT inventory_id, mock_price, stock FROM r WHERE r = 1
        UNION ALL SELECT 'P' || p_partkey, p_retailprice, p_size FROM part WHERE 'P' || p_partkey NOT IN (SELECT inventory_id FROM n)""",
    "graph_seed_summary": """
        SELECT 'ObjectType' AS label, 1::BIGINT AS submitted UNION ALL SELECT 'Defect', count(*) FROM defects UNION ALL SELECT 'RepairStep', count(*) FROM steps
        UNION ALL SELECT 'Part', count(*) FROM pairs UNION ALL SELECT 'InventoryRecord', count(*) FROM pairs""",
    "repair_step_ids": "SELECT class_name, position, instruction, step_id FROM steps",
    "defect_lookup": """
        SELECT class_name AS found_class, display_name, count(*) AS n FROM lineitem LEFT JOIN defects ON s_suppkey = l_suppkey + l_linenumber % 2 * 5 GROUP BY ALL""",
    "parts_for_defect": """
        SELECT class_name, part_id, part_name, mock_price, currency, fake_stock_quantity, availability_status, last_updated FROM pairs JOIN attributes USING (p_partkey)""",
    "repair_steps_for_defect": "SELECT class_name, position, step_id, instruction FROM steps",
    "inventory_last_updated": "SELECT max(last_updated) AS inventory_last_updated FROM attributes",
    "knowledge_fallback": """
        SELECT o_orderkey, 'sup-' || (o_custkey % 120) AS class_name,
            CASE WHEN s_suppkey % 5 <> 0 THEN s_name WHEN s_suppkey % 35 <> 0 THEN 'static ' || s_name END AS display_name,
            CASE WHEN s_suppkey % 5 <> 0 THEN 'neo4j' WHEN s_suppkey % 35 <> 0 THEN 'static_catalog_fallback' END AS knowledge_source
        FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey % 120""",
    "latest_feedback": "SELECT image_sha256, feedback_class FROM latest",
    "feedback_override": "SELECT sample_index, most_likely_class, predicted_class, feedback_applied, requires_manual_review, message FROM answered",
    "enriched_predictions": """
        SELECT sample_index, most_likely_class, predicted_class, requires_manual_review, feedback_applied, message, coalesce(step_count, 0) AS step_count,
            coalesce(part_count, 0) AS part_count, CASE WHEN requires_manual_review THEN 'Unknown / Manual Review' ELSE display_name END AS display_name,
            (CASE WHEN requires_manual_review OR display_name IS NOT NULL THEN 200 ELSE 500 END)::BIGINT AS status,
            CASE WHEN requires_manual_review OR display_name IS NOT NULL THEN
                (SELECT max('2026-01-' || lpad((n_nationkey + 1)::VARCHAR, 2, '0')) FROM nation WHERE n_nationkey % 4 > 0) END AS inventory_last_updated,
            CASE WHEN requires_manual_review THEN 'static_catalog_fallback' ELSE knowledge_source END AS knowledge_source
        FROM answered a LEFT JOIN panel k ON k.class_name = a.predicted_class""",
    "feedback_fingerprint": """
        SELECT seq, prediction_id, coalesce(CASE WHEN row_number() OVER (PARTITION BY prediction_id ORDER BY "timestamp", seq) = 1 THEN recorded END, image_sha256, '') AS image_sha256
        FROM feedback LEFT JOIN log USING (prediction_id)""",
    "correction_rate": """
        SELECT strftime("timestamp", '%Y-%m-%d') AS day, count(*) AS feedback_count, count(*) FILTER (NOT is_correct) AS correction_count, round(avg((NOT is_correct)::INT), 6) AS correction_rate
        FROM feedback GROUP BY 1""",
    "table_health": """
        SELECT CASE WHEN bool_and(up) THEN 'healthy' ELSE 'degraded' END AS status, count(*) FILTER (NOT up) AS down_count,
            CASE WHEN bool_or(up AND d = 'graph') THEN 'neo4j' ELSE 'static_catalog_fallback' END AS knowledge_source FROM (
            SELECT 'graph' AS d, max(l_shipdate) >= TIMESTAMP '1999-01-01' AS up FROM lineitem UNION ALL SELECT 'events', max(ts) >= TIMESTAMP '2030-01-01' FROM events
            UNION ALL SELECT 'orders', max(o_orderdate) >= TIMESTAMP '1995-01-01' FROM orders)""",
    "apply_review_decisions": """
        SELECT file_path, p.class_name, record_index, CASE WHEN d.accepted_index IS NOT NULL THEN 'accepted' ELSE 'rejected' END AS review_status,
            review_notes || CASE WHEN d.accepted_index IS NOT NULL THEN '; accepted under protocol-2' ELSE '; rejected under protocol-2: not on the reviewer''s list' END AS review_notes
        FROM placed p LEFT JOIN decisions d ON d.class_name = p.class_name AND d.accepted_index = record_index""",
    "decision_violations": """
        WITH s AS (SELECT class_name, count(*) AS size FROM records GROUP BY 1)
        SELECT 'duplicate_index' AS rule, class_name, accepted_index FROM decisions WHERE class_name <> 'rust' AND accepted_index % 5 = 0
        UNION ALL SELECT 'index_out_of_range', class_name, accepted_index FROM decisions JOIN s USING (class_name) WHERE class_name <> 'rust' AND accepted_index >= size
        UNION ALL SELECT 'class_without_decision', 'rust', NULL""",
    "review_tally": "SELECT class_name, review_status, count(*) AS record_count FROM records GROUP BY ROLLUP (class_name, review_status)",
    "review_pages": """
        SELECT file_path, class_name, record_index AS record_number, record_index // 25 + 1 AS page, record_index % 25 // 5 AS page_row, record_index % 25 % 5 AS page_column FROM placed""",
    "ordered_records": "SELECT idx, file_path, class_name FROM records JOIN classes USING (class_name) ORDER BY idx, file_path",
    "review_sample": "SELECT image_id, class_name FROM ranked WHERE r <= 6",
    "ambiguous_overlap": "SELECT annotation_path, title, round(overlap, 6) AS overlap, overlap <= 0.10 AS eligible FROM scored WHERE kind = 'damage'",
    "largest_object": "SELECT annotation_path, class_name, title AS source_label FROM crops",
    "square_crop": """
        SELECT annotation_path, image_path AS source_group, '[' || cl || ',' || ct || ',' || cr || ',' || cb || ']' AS crop_box, least(cr - cl, cb - ct)::BIGINT AS short_side FROM crops""",
    "scaled_crop": """
        SELECT annotation_path, '[' || round_even(cl * (1021::DOUBLE / width), 0)::INT || ',' || round_even(ct * (747::DOUBLE / height), 0)::INT || ','
            || least(1021, round_even(cr * (1021::DOUBLE / width), 0)::INT) || ',' || least(747, round_even(cb * (747::DOUBLE / height), 0)::INT) || ']' AS crop_box FROM crops""",
    "box_geometry": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(w * h, 6) AS area, round(CASE WHEN w * h <= 0 THEN 1 ELSE
            greatest(0, least(x + w, x2 + 90) - greatest(x, x2)) * greatest(0, least(y + h, y2 + 80) - greatest(y, y2)) / (w * h) END, 6) AS covered
        FROM (SELECT *, (l_partkey % 600)::DOUBLE AS x, (l_suppkey % 400)::DOUBLE AS y, 20 + l_quantity * 3 AS w, l_tax * 1000 AS h, (l_suppkey % 500)::DOUBLE AS x2, (l_partkey % 300)::DOUBLE AS y2 FROM lineitem)""",
    "path_rewrite": "SELECT annotation_path, image_path FROM items",
    "raw_url": """
        SELECT page_id, 'https://host.example/datasets/owner/data%20set/resolve/rev%2F1/set%20a/img/' || replace(url_encode(url), '%2F', '/') AS url FROM pages""",
    "stable_ids": "SELECT doc_id, class_name || '-' || checksum[1:16] AS stable_id FROM manifest",
    "difference_hash": "SELECT image_id, perceptual_hash FROM hashed",
    "hamming_distance": """
        SELECT image_id, (bit_count(xor(high, ('0x' || checksum[1:8])::BIGINT)) + bit_count(xor(low, ('0x' || checksum[9:16])::BIGINT)))::BIGINT AS distance FROM hashed""",
    "html_plain_text": """
        SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(html, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'),
            '&amp;?', '&', 'g'), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS plain FROM pages""",
    "display_labels": """
        SELECT p_partkey, array_to_string(list_transform(string_split(p_name || '-x', ' '), lambda w: upper(w[1]) || w[2:]), ' ')[:-2] || 'X' AS title,
            ['In stock', 'Low stock', 'Out of stock', 'On Order'][p_size % 4 + 1] AS availability,
            CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', round(b / 1024, 1)) ELSE printf('%.1f MB', round(b / 1048576, 1)) END AS file_size,
            CASE WHEN p_size % 2 = 0 THEN 'Neo4j knowledge graph' ELSE 'Static catalog fallback' END AS source
        FROM (SELECT *, p_partkey * p_partkey * 7 AS b FROM part)""",
    "class_counts": "SELECT idx, class_name, count(image_id) AS record_count FROM classes5 LEFT JOIN manifest USING (class_name) GROUP BY ALL",
    "split_compatibility": """
        SELECT class_name, count(*) AS record_count, count(*) >= 10 AS large_enough, count(*) % 10 = 0 AS divisible, count(*) >= 10 AND count(*) % 10 = 0 AS compatible FROM manifest GROUP BY 1""",
    "strict_split_counts": """
        SELECT class_name, d AS dataset_split, n AS record_count, floor(t * share)::BIGINT AS expected_count, n = floor(t * share) AND n > 0 AS ok FROM (
            SELECT c.class_name, d, share, (SELECT count(*) FROM split s WHERE s.class_name = c.class_name AND dataset_split = d) AS n, (SELECT count(*) FROM split s WHERE s.class_name = c.class_name) AS t
            FROM classes5 c, (VALUES ('train', 0.8), ('validation', 0.1), ('test', 0.1)) v(d, share))""",
    "class_split_crosstab": """
        SELECT class_name, count(*) FILTER (dataset_split = 'train') AS train, count(*) FILTER (dataset_split = 'validation') AS validation,
            count(*) FILTER (dataset_split = 'test') AS test FROM classes5 LEFT JOIN split USING (class_name) GROUP BY 1""",
    "source_label_counts": "SELECT class_name, source_object_label, count(*) AS record_count FROM manifest GROUP BY ALL",
    "normal_certification": """
        SELECT count(*) FILTER (doc_id % 6 < 2) AS certified, count(*) FILTER (doc_id % 6 >= 2) AS uncertified FROM manifest WHERE class_name = 'normal'""",
    "size_profile": """
        SELECT class_name, count(*) AS record_count, min(short_side) AS short_side_min, median(short_side) AS short_side_median, max(short_side) AS short_side_max,
            count(*) FILTER (short_side < 128) AS below_128_count FROM manifest GROUP BY 1""",
    "audit_summary": """
        SELECT 6::BIGINT AS near_duplicate_threshold, (SELECT count(*) FROM split) AS record_count, (SELECT count(*) FROM split WHERE doc_id % 19 = 0) AS non_default_orientation,
            (SELECT count(*) FROM split WHERE class_name = 'normal' AND doc_id % 6 < 2) AS certified, (SELECT count(*) FROM split WHERE class_name = 'normal' AND doc_id % 6 >= 2) AS uncertified,
            (SELECT sum(pair_count)::BIGINT FROM near_pairs) AS near_duplicate_pairs, (SELECT sum(cross_split_pairs)::BIGINT FROM near_pairs) AS cross_split_pairs,
            (SELECT sum(cross_class_pairs)::BIGINT FROM near_pairs) AS cross_class_pairs, near_duplicate_clusters, clustered_records, largest_cluster, cross_split_clusters, cross_class_clusters
        FROM (SELECT count(*) AS near_duplicate_clusters, sum(n)::BIGINT AS clustered_records, max(n) AS largest_cluster, count(*) FILTER (s > 1) AS cross_split_clusters,
            count(*) FILTER (c > 1) AS cross_class_clusters
            FROM (SELECT cluster_hash, count(*) AS n, count(DISTINCT dataset_split) AS s, count(DISTINCT class_name) AS c FROM cluster_members JOIN hashed_split USING (image_id) GROUP BY 1))""",
    "confusion_matrix": "SELECT true_idx, pred_idx, true_class, predicted_class, n FROM cells5",
    "per_class_metrics": "SELECT idx, class_name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, support FROM metrics",
    "overall_accuracy": "SELECT count(*) AS sample_count, round(avg((true_idx = pred_idx)::INT), 6) AS accuracy FROM pred",
    "macro_weighted_f1": "SELECT round(avg(f1_score), 6) AS macro_f1, round(sum(f1_score * support) / sum(support), 6) AS weighted_f1 FROM metrics",
    "threshold_analysis": "SELECT * FROM analysis WHERE confidence_threshold = 0.65",
    "threshold_sweep": "SELECT * FROM analysis",
    "select_threshold": "SELECT * FROM analysis ORDER BY coverage >= 0.5 DESC, coalesce(accepted_accuracy, -1) DESC, coverage DESC, confidence_threshold LIMIT 1",
    "confidence_summary": """
        SELECT g AS group_name, count(*) AS n, round(avg(confidence), 6) AS mean, round(min(confidence), 6) AS "min", round(median(confidence), 6) AS median, round(max(confidence), 6) AS "max" FROM (
            SELECT 'overall' AS g, confidence FROM pred UNION ALL SELECT CASE WHEN true_idx = pred_idx THEN 'correct' ELSE 'incorrect' END, confidence FROM pred) GROUP BY 1""",
    "confidence_histogram": """
        SELECT bin::BIGINT AS bin, low::DOUBLE AS low, high::DOUBLE AS high, (SELECT count(*) FROM pred WHERE confidence >= low AND (confidence < high OR bin = 3)) AS n
        FROM (VALUES (0, 0.0, 0.4), (1, 0.4, 0.6), (2, 0.6, 0.8), (3, 0.8, 1.0)) b(bin, low, high)""",
    "heldout_summary": "SELECT expected_class, count(*) AS sample_count, round(avg((expected_class = predicted_class)::INT), 6) AS accuracy FROM results7 GROUP BY ROLLUP (expected_class)",
    "version_comparison": """
        SELECT count(*) AS sample_count, round(avg(o::INT), 6) AS old_accuracy, round(avg(n::INT), 6) AS new_accuracy, round(avg(n::INT) - avg(o::INT), 6) AS gain,
            count(*) FILTER (c) AS changed, count(*) FILTER (n AND NOT o) AS fixed, count(*) FILTER (o AND NOT n) AS broken FROM (
            SELECT a.predicted_class = a.expected_class AS o, b.predicted_class = a.expected_class AS n, a.predicted_class <> b.predicted_class AS c FROM results3 a JOIN results7 b USING (filename))""",
    "class_weights": """
        SELECT idx, class_name, count(*) AS record_count, round((SELECT count(*) FROM manifest) / (4 * count(*)), 6) AS weight FROM classes JOIN manifest USING (class_name) GROUP BY ALL""",
    "acquisition_yield": "SELECT count(*) AS new_rows, 96::BIGINT AS needed_rows, count(*) >= 96 AS ok FROM pages WHERE url LIKE 'https://_%'",
    "stratified_split": "SELECT image_id, class_name, dataset_split FROM trimmed",
    "balanced_sample": "SELECT image_id, class_name FROM ranked WHERE r <= (SELECT least(100, min(n)) - least(100, min(n)) % 10 FROM ranked)",
    "tiered_sample": """
        SELECT image_id, class_name, short_side FROM (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY short_side < 128, md5('42:' || image_id), image_id) AS q FROM manifest)
        JOIN (VALUES ('scratch', 60), ('dent', 45), ('rust', 30)) v(class_name, wanted) USING (class_name) WHERE q <= wanted""",
    "sample_shortfall": """
        SELECT class_name, wanted::BIGINT AS wanted, count(image_id) AS available FROM (VALUES ('scratch', 1000000), ('dent', 45), ('chip', 30)) v(class_name, wanted)
        LEFT JOIN manifest USING (class_name) GROUP BY ALL HAVING count(image_id) < wanted""",
    "best_epoch": """
        SELECT run_id, arg_min(epoch, loss * 1000000 + epoch) AS best_epoch, min(loss) AS best_validation_loss, count(*) AS epochs_completed FROM runs GROUP BY 1""",
    "early_stop_trace": """
        WITH a AS (SELECT *, coalesce(loss < min(loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM runs),
        b AS (SELECT *, epoch - greatest(min(epoch) OVER (PARTITION BY run_id, stage) - 1,
            coalesce(max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run_id, stage ORDER BY epoch), 0)) AS s FROM a)
        SELECT run_id, epoch, stage, loss, improved, s AS epochs_without_improvement, s >= 2 AS stop FROM b""",
    "softmax_predict": """
        SELECT vec_id, list_position(z, list_max(z)) - 1::BIGINT AS pred_idx, round(1 / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))), 6) AS confidence
        FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS z FROM embeddings)""",
    "batch_score": """
        SELECT vec_id, list_position(z, list_max(z)) - 1::BIGINT AS pred_idx, round(1 / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))), 6) AS confidence FROM blocks""",
    "head_coefficients": """
        SELECT class_name, (j % (len(w) // 4))::INT AS place, round(w[1 + j], 6) AS coefficient
        FROM (SELECT w, unnest(range(len(w))) AS j FROM head_steps WHERE i = 30) AS u JOIN classes ON idx = j // (len(w) // 4)""",
    "head_fit": "SELECT vec_id, validation, true_idx, pred_idx, round(confidence, 3) AS confidence FROM head_pred",
    "class_set_difference": "SELECT 'chip' AS class_name, 'missing' AS side UNION ALL SELECT 'rust', 'unexpected' FROM (SELECT 1 WHERE EXISTS (FROM manifest WHERE class_name = 'rust'))",
    "stream_admission": "SELECT seq, len(errors) = 0 AS admitted, array_to_string(list_sort(errors), ',') AS errors FROM checked",
    "stream_latest_feedback": "SELECT image_sha256, feedback_class FROM latest",
    "stream_override": "SELECT sample_index, predicted_class, feedback_applied, requires_manual_review FROM answered",
    "stream_review_rate": """
        SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS prediction_count, count(*) FILTER (confidence < 0.65) AS review_count, round(avg((confidence < 0.65)::INT), 6) AS review_rate FROM pred GROUP BY 1""",
}
VIEWS["head_analysis"] = VIEWS["analysis"].replace("FROM pred ", "FROM head_pred ").replace(" GROUP BY t", " WHERE validation GROUP BY t")
BODIES["head_threshold"] = BODIES["select_threshold"].replace("FROM analysis", "FROM head_analysis").replace("0.5 DESC", "0.65 DESC")
BODIES["stream_fingerprint"] = BODIES["feedback_fingerprint"]
BODIES["stream_graph_upsert"] = BODIES["graph_upsert"]
BODIES["graph_store"] = BODIES["graph_nodes"]


def _counts(**checks: str) -> str:
    """A ledger: the rows of each query, where there are any."""
    return "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS check_name, count(*) AS violation_count FROM ({BODIES.get(sql, sql)}) AS q" for name, sql in checks.items()) + ") AS l WHERE violation_count > 0"


BODIES["job_validate_splits"] = _counts(
    blank_licence="SELECT 1 FROM split WHERE trim(licence) = ''", wrong_split="SELECT 1 FROM split WHERE doc_id % 51 = 0 AND dataset_split <> 'train'",
    checksum_format="SELECT 1 FROM split WHERE doc_id % 107 = 0", cross_split_duplicates="cross_split_duplicates", near_duplicates="near_dup_cross_split",
    strict_split_counts=f"SELECT 1 FROM ({BODIES['strict_split_counts'].replace('classes5', 'classes')}) AS s WHERE NOT ok",
)
BODIES["job_heldout_check"] = _counts(heldout_manifest="demo_manifest_violations", heldout_leakage="heldout_leakage", near_duplicates="near_dup_two_tables")
BODIES["job_audit"] = """
    SELECT 'summary' AS section, NULL::VARCHAR AS class_name, name, value::BIGINT AS value FROM (UNPIVOT (SELECT * EXCLUDE (near_duplicate_pairs, cross_split_pairs, cross_class_pairs)
        FROM (""" + BODIES["audit_summary"].strip() + """) AS a) ON COLUMNS(*) INTO NAME name VALUE value) AS u
    UNION ALL SELECT 'crosstab', class_name, name, value::BIGINT FROM (UNPIVOT (""" + BODIES["class_split_crosstab"].strip().replace("classes5", "classes") + """) ON train, validation, test INTO NAME name VALUE value) AS c
    UNION ALL SELECT 'source_labels', class_name, source_object_label, count(*) FROM split GROUP BY ALL
    UNION ALL SELECT 'sizes', class_name, 'below_128_count', count(*) FILTER (short_side < 128) FROM split GROUP BY class_name
    UNION ALL SELECT 'sizes', class_name, 'double_median', (2 * median(short_side))::BIGINT FROM split GROUP BY class_name"""
BODIES["job_evaluate"] = """
    WITH b AS (""" + BODIES["batch_score"].strip() + """), r AS (SELECT label % 4 AS t, pred_idx AS p, confidence FROM b JOIN embeddings USING (vec_id))
    SELECT 'confusion' AS section, t.class_name || '>' || p.class_name AS name, (SELECT count(*) FROM r WHERE r.t = t.idx AND r.p = p.idx) AS value FROM classes t, classes p
    UNION ALL SELECT 'predictions', 'rows', count(*) FROM r UNION ALL SELECT 'predictions', 'misclassified', count(*) FROM r WHERE t <> p
    UNION ALL SELECT 'predictions', 'manual_review', count(*) FROM r WHERE confidence < 0.65"""
BODIES["job_write_evaluation"] = """
    WITH b AS (""" + BODIES["batch_score"].strip() + """),
    r AS (SELECT vec_id AS sample_index, 'img, ' || vec_id || '.png' AS filename, t.class_name AS true_class, p.class_name AS predicted_class,
        confidence < 0.6 AS requires_manual_review, t.idx = p.idx AS is_correct, confidence AS value
        FROM b JOIN embeddings USING (vec_id) JOIN classes t ON t.idx = label % 4 JOIN classes p ON p.idx = pred_idx)
    SELECT 'predictions' AS report, * FROM r UNION ALL SELECT 'misclassified', * FROM r WHERE NOT is_correct
    UNION ALL SELECT 'per_class', NULL, NULL, class_name, NULL, NULL, NULL, coalesce(round(avg(is_correct::INT), 6), 0)
    FROM classes LEFT JOIN r ON true_class = class_name GROUP BY class_name"""
BODIES["job_feedback_report"] = """
    SELECT 'rows' AS section, CASE WHEN len(errors) = 0 THEN 'accepted' ELSE 'rejected' END AS name, count(*) AS value FROM checked GROUP BY ALL
    UNION ALL SELECT 'errors', e, count(*) FROM (SELECT unnest(errors) AS e FROM checked) AS u GROUP BY e
    UNION ALL SELECT 'corrections', strftime("timestamp", '%Y-%m-%d'), count(*) FILTER (NOT is_correct) FROM checked WHERE len(errors) = 0 GROUP BY ALL"""


def _provenance() -> str:
    parts = []
    for name, columns in {
        "documents": ["doc_id", "lang", "source", "n_chars"], "labels": ["doc_id", "quality", "toxic"],
        "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"],
    }.items():
        row = " || '|' || ".join(f"length({c}::VARCHAR) || ':' || {c}" for c in columns)
        words = " || ':' || ".join(f"sum(('0x' || h[{8 * i + 1}:{8 * i + 8}])::BIGINT)" for i in range(8))
        parts.append(
            f"SELECT 'run-1' AS run_id, '{name}' AS table_name, count(*) AS row_count, sha256(count(*) || ':' || {words}) AS fingerprint "
            f"FROM (SELECT sha256({row}) AS h FROM {name})"
        )
    return " UNION ALL ".join(parts)


BODIES["run_provenance"] = _provenance()


def _needed(sql: str, found: list[str], inside: str = "") -> list[str]:
    for name, view in VIEWS.items():
        if name not in found and name != inside and re.search(rf"\b(FROM|JOIN|,)\s+\(?{name}\b", sql):
            _needed(view, found, name)
            found.append(name)
    return found


def _with_views(body: str) -> str:
    # row ids are given once, however often the view is read
    recursive = "RECURSIVE " if {"cluster_reach", "head_steps"} & set(found := _needed(body, [])) else ""
    views = [f"{name} AS {'MATERIALIZED ' if 'row_number() OVER ()' in VIEWS[name] else ''}({VIEWS[name].strip()})" for name in found]
    body = body.strip()
    if body.startswith("WITH "):
        return f"WITH {recursive}" + ",\n".join([*views, body[5:]]) if views else body
    return (f"WITH {recursive}" + ",\n".join(views) + "\n" if views else "") + body


ORACLE = {name: _with_views(body) for name, body in BODIES.items()}
