"""Vulnerability-shaped views of the star-schema tables, in SQL that both engines read alike."""

FIXTURES = {
    "fx_affected": """SELECT l_orderkey*10+l_linenumber AS row_id, CAST(l_orderkey%500 AS bigint) AS vuln_no,
  replace(p_name,' ','-') AS package_name,
  CASE p_size%6 WHEN 0 THEN 'npm' WHEN 1 THEN 'PyPI' WHEN 2 THEN 'Debian:12' WHEN 3 THEN 'Ubuntu:22.04:LTS'
    WHEN 4 THEN 'Red Hat:9' ELSE 'AlmaLinux:9' END AS ecosystem,
  CAST(l_linenumber AS varchar(10)) || '.' || CAST(CAST(l_quantity AS int)%20 AS varchar(10)) || '.0' AS introduced_version,
  CASE WHEN l_returnflag='N' THEN NULL ELSE CAST(l_linenumber+1 AS varchar(10)) || '.' ||
    CAST(CAST(l_quantity AS int)%10 AS varchar(10)) || '.' || CAST(l_suppkey%30 AS varchar(10)) END AS fixed_version,
  CASE WHEN l_returnflag='N' AND l_linestatus='O' THEN CAST(l_linenumber AS varchar(10)) || '.' ||
    CAST(CAST(l_quantity AS int) AS varchar(10)) || '.9' END AS last_affected_version
FROM lineitem JOIN part ON l_partkey=p_partkey""",
    "fx_installed": """SELECT p_partkey AS request_id, replace(p_name,' ','-') AS package_name, CAST(p_size%8 AS varchar(10)) || '.' ||
  CAST(p_partkey%25 AS varchar(10)) || '.' || CAST(p_partkey%7 AS varchar(10)) AS version FROM part""",
    "fx_master": """SELECT CAST(o_orderkey AS bigint) AS vuln_no,
  CASE WHEN o_orderkey%4<>3 THEN 'CVE-2024-' || CAST(10000+o_orderkey AS varchar(10)) END AS cve_id,
  'GHSA-' || CAST(o_orderkey AS varchar(10)) AS osv_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM'
    WHEN '5-LOW' THEN 'LOW' END AS severity, o_orderdate AS published_at FROM orders""",
    "fx_kev": "SELECT 'CVE-2024-' || CAST(10000+s_suppkey*7 AS varchar(10)) AS cve_id, s_name AS product FROM supplier",
    "fx_epss": "SELECT 'CVE-2024-' || CAST(10000+c_custkey AS varchar(10)) AS cve_id, c_custkey%1000 AS score_milli FROM customer",
    "fx_jobs": """SELECT event_id AS job_id, 'osv-' || event_type AS source, CASE WHEN user_id%5=0 THEN 'failed' ELSE 'completed' END AS status,
  ts AS completed_at, CAST(user_id AS bigint) AS total_inserted FROM events""",
}
