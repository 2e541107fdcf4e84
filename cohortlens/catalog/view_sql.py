"""SQL bodies of the records views, shared by every equivalent SQL statement."""

VIEW_SQL = {
    "enrolment_v": """
SELECT o.o_custkey AS student,
       10 * (year(o.o_orderdate) - 1800) + CASE WHEN month(o.o_orderdate) <= 5 THEN 2 WHEN month(o.o_orderdate) <= 8 THEN 3 ELSE 4 END AS strm,
       n.n_name AS college, l.l_suppkey AS instructor, upper(substr(p.p_type, 1, 3)) AS subject,
       CASE WHEN l.l_partkey % 17 = 0 THEN CAST(1 + l.l_partkey % 9 AS STRING)
            WHEN l.l_partkey % 19 = 0 THEN CAST(100 + l.l_partkey % 200 AS STRING) || 'L'
            ELSE CAST(100 + l.l_partkey % 200 AS STRING) END AS course_num,
       l.l_linenumber AS section, l.l_quantity % 5 AS credit,
       CASE l.l_suppkey % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'E' ELSE 'O' END AS day_eve_code,
       CASE WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'F' THEN 'A' WHEN l.l_returnflag = 'R' THEN 'B'
            WHEN l.l_returnflag = 'A' AND l.l_linestatus = 'F' THEN 'C'
            WHEN l.l_returnflag = 'A' THEN CASE WHEN l.l_quantity < 25 THEN 'D' ELSE 'F' END
            WHEN l.l_linestatus = 'F' THEN 'W' ELSE NULL END AS grade
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey""",
    "student_v": """
SELECT c_custkey AS student,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'white' WHEN 'BUILDING' THEN 'afam' WHEN 'FURNITURE' THEN 'hisp' WHEN 'HOUSEHOLD' THEN 'asian' ELSE 'other' END AS grp,
       c_nationkey AS home, c_acctbal AS balance, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender
FROM customer""",
    "scores_v": """
SELECT o.o_orderkey AS id, v.grp, CASE WHEN o.o_orderstatus = 'F' THEN 0 ELSE 1 END AS y,
       CAST(floor(o.o_totalprice % 1000) AS DOUBLE) / CAST(1000 AS DOUBLE) AS score, CASE WHEN year(o.o_orderdate) >= 2000 THEN 1 ELSE 0 END AS valid
FROM orders o JOIN student_v v ON o.o_custkey = v.student""",
    "spells_v": """
SELECT o.o_custkey AS student, n.n_name AS college, least(CAST(o.o_orderdate AS DATE), max(CAST(l.l_shipdate AS DATE))) AS begin_date,
       greatest(CAST(o.o_orderdate AS DATE), max(CAST(l.l_shipdate AS DATE))) AS end_date,
       CAST(CASE o.o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.75 WHEN '3-MEDIUM' THEN 0.5 WHEN '5-LOW' THEN 0.25 ELSE NULL END AS DOUBLE) AS intensity
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
GROUP BY o.o_custkey, n.n_name, CAST(o.o_orderdate AS DATE), o.o_orderpriority""",
    "snapshot_v": """
SELECT o_custkey AS student, o_orderkey AS source,
       10 * (year(o_orderdate) - 1800) + CASE WHEN month(o_orderdate) <= 5 THEN 2 WHEN month(o_orderdate) <= 8 THEN 3 ELSE 4 END AS strm,
       CAST(floor(o_totalprice % 18) AS BIGINT) AS total_credit_hrs, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS dual_enrollment,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'AA&S' WHEN '2-HIGH' THEN 'AAS' WHEN '3-MEDIUM' THEN 'CERT' WHEN '5-LOW' THEN 'CSC' ELSE NULL END AS deglvl,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(20000 + o_orderkey % 37 AS STRING) END AS zcta,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice % 100 END AS distance,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 6 END AS fhe, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderkey % 5 END AS mhe
FROM orders""",
    "aid_v": """
SELECT o_custkey AS student, year(o_orderdate) AS year,
       CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE 1000 * (o_custkey % 9) END AS budget,
       sum(CASE WHEN month(o_orderdate) <= 5 THEN 3 ELSE 0 END) AS credspr, sum(CASE WHEN month(o_orderdate) BETWEEN 6 AND 8 THEN 3 ELSE 0 END) AS credsum,
       sum(CASE WHEN month(o_orderdate) > 8 THEN 3 ELSE 0 END) AS credfal,
       sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0 END) AS pell, sum(o_totalprice) AS grants
FROM orders GROUP BY o_custkey, year(o_orderdate)""",
    "prereq_v": """
SELECT DISTINCT e.subject || '_' || e.course_num AS course, e.subject || '_' || CAST(TRY_CAST(e.course_num AS INT) - 1 AS STRING) AS prereq
FROM enrolment_v e WHERE length(e.course_num) = 3 AND e.course_num > '100'""",
}
