"""The features again in DuckDB SQL, from square lists and joins instead of square sets."""

from __future__ import annotations

from rookery.sources.fixtures import PIECES, POSITIONS

BASE = f"""WITH RECURSIVE pos AS MATERIALIZED ({POSITIONS}), men0 AS MATERIALIZED ({PIECES}),
sqs AS (SELECT CAST(range AS INT) AS s, CAST(range // 8 AS INT) AS f, CAST(range % 8 AS INT) AS r FROM range(64)),
ln AS MATERIALIZED (SELECT k.pc, d.side, a.s AS sq, b.s AS dst FROM sqs a, sqs b, (SELECT CAST(range AS INT) AS pc FROM range(6)) k, (SELECT CAST(range AS INT) AS side FROM range(2)) d
  WHERE a.s <> b.s AND CASE k.pc WHEN 0 THEN abs(a.f-b.f)=1 AND b.r-a.r=1-2*d.side WHEN 1 THEN abs(a.f-b.f)*abs(a.r-b.r)=2
    WHEN 2 THEN abs(a.f-b.f)=abs(a.r-b.r) WHEN 3 THEN a.f=b.f OR a.r=b.r WHEN 4 THEN a.f=b.f OR a.r=b.r OR abs(a.f-b.f)=abs(a.r-b.r)
    ELSE greatest(abs(a.f-b.f),abs(a.r-b.r))=1 END),
mid AS MATERIALIZED (SELECT a.s AS sq, b.s AS dst, c.s AS m FROM sqs a, sqs b, sqs c
  WHERE a.s<>b.s AND (a.f=b.f OR a.r=b.r OR abs(a.f-b.f)=abs(a.r-b.r)) AND c.s<>a.s AND c.s<>b.s
    AND greatest(abs(a.f-c.f),abs(a.r-c.r))+greatest(abs(b.f-c.f),abs(b.r-c.r))=greatest(abs(a.f-b.f),abs(a.r-b.r))
    AND (a.f-c.f)*(b.r-a.r)=(a.r-c.r)*(b.f-a.f)),
cov AS MATERIALIZED (SELECT o.pos_id, m.sq, m.dst, COUNT(*) AS n, MIN(o.sq) AS only_sq FROM mid m JOIN men0 o ON o.sq=m.m GROUP BY 1,2,3),
men AS MATERIALIZED (SELECT p.pos_id, p.sq, p.side, p.pc, least(p.sq//8, 7-p.sq//8) AS f, CASE WHEN p.side=0 THEN p.sq%8 ELSE 7-p.sq%8 END AS r, p.sq//8 AS fl, p.sq%8 AS rk,
  CASE WHEN p.side=0 THEN k.wk ELSE k.bk END AS king, CASE WHEN p.side=0 THEN k.bk ELSE k.wk END AS xking, k.turn, k.rights FROM men0 p JOIN pos k USING (pos_id)),
att AS MATERIALIZED (SELECT p.pos_id, p.side, p.pc, p.sq, l.dst FROM men0 p JOIN ln l ON l.pc=p.pc AND l.side=p.side AND l.sq=p.sq
  LEFT JOIN cov c ON p.pc IN (2,3,4) AND c.pos_id=p.pos_id AND c.sq=l.sq AND c.dst=l.dst WHERE c.n IS NULL),
patt AS MATERIALIZED (SELECT DISTINCT pos_id, side, dst FROM att WHERE pc=0),
both_sides AS (SELECT p.*, d.side, CASE WHEN d.side=0 THEN wk ELSE bk END AS king, CASE WHEN d.side=0 THEN bk ELSE wk END AS xking FROM pos p, (SELECT CAST(range AS INT) AS side FROM range(2)) d),
hit AS MATERIALIZED (SELECT pos_id, side, dst, MIN(pc) AS least_pc, COUNT(DISTINCT CASE WHEN pc=0 THEN -1 ELSE sq END) AS n FROM att GROUP BY 1,2,3),
qsafe AS MATERIALIZED (SELECT b.pos_id, b.side, q.s FROM both_sides b CROSS JOIN sqs q LEFT JOIN hit x ON x.pos_id=b.pos_id AND x.side=1-b.side AND x.dst=q.s
  LEFT JOIN hit o ON o.pos_id=b.pos_id AND o.side=b.side AND o.dst=q.s WHERE x.least_pc IS NULL OR (x.least_pc=5 AND o.n>=2)),
psafe AS MATERIALIZED (SELECT b.pos_id, b.side, q.s FROM both_sides b CROSS JOIN sqs q WHERE NOT EXISTS (SELECT 1 FROM men0 o WHERE o.pos_id=b.pos_id AND o.side=b.side AND o.pc=0 AND o.sq=q.s)
  AND NOT EXISTS (SELECT 1 FROM patt x WHERE x.pos_id=b.pos_id AND x.side=1-b.side AND x.dst=q.s)),
zone AS MATERIALIZED (SELECT b.pos_id, b.side, q.s FROM both_sides b JOIN sqs q ON abs(q.f-least(greatest(b.king//8,1),6))<=1 AND abs(q.r-least(greatest(b.king%8,1),6))<=1),
pawn AS MATERIALIZED (SELECT * FROM men WHERE pc=0),
shut AS MATERIALIZED (SELECT b.pos_id, b.side, q.s FROM both_sides b CROSS JOIN sqs q WHERE EXISTS (SELECT 1 FROM pawn p WHERE p.pos_id=b.pos_id AND p.sq=q.s)
  OR (EXISTS (SELECT 1 FROM patt x WHERE x.pos_id=b.pos_id AND x.side=1-b.side AND x.dst=q.s) AND NOT EXISTS (SELECT 1 FROM patt o WHERE o.pos_id=b.pos_id AND o.side=b.side AND o.dst=q.s))),
fwd AS (SELECT pos_id, side, sq FROM pawn UNION SELECT w.pos_id, w.side, w.sq+1-2*w.side FROM fwd w WHERE w.sq%8<>7-7*w.side
  AND NOT EXISTS (SELECT 1 FROM shut u WHERE u.pos_id=w.pos_id AND u.side=w.side AND u.s=w.sq+1-2*w.side)),
bwd AS (SELECT p.pos_id, p.side, q.s AS sq FROM pawn p JOIN sqs q ON abs(q.f-p.fl)=1 AND q.r=p.rk UNION SELECT w.pos_id, w.side, w.sq-1+2*w.side FROM bwd w WHERE w.sq%8<>7*w.side
  AND NOT EXISTS (SELECT 1 FROM shut u WHERE u.pos_id=w.pos_id AND u.side=w.side AND u.s=w.sq)),
weak AS MATERIALIZED (SELECT p.* FROM pawn p WHERE NOT EXISTS (SELECT 1 FROM fwd w WHERE w.pos_id=p.pos_id AND w.side=p.side AND abs(w.sq//8-p.fl)=1 AND p.rk-w.sq%8 IN (0, 1-2*p.side))
  AND NOT EXISTS (SELECT 1 FROM bwd w WHERE w.pos_id=p.pos_id AND w.side=p.side AND w.sq=p.sq)),
xreach AS MATERIALIZED (SELECT DISTINCT w.pos_id, 1-w.side AS side, q.s FROM fwd w JOIN sqs q ON abs(q.f-w.sq//8)=1 AND q.r-w.sq%8=1-2*w.side),
prot AS MATERIALIZED (SELECT m.* FROM men m WHERE EXISTS (SELECT 1 FROM patt a WHERE a.pos_id=m.pos_id AND a.side=m.side AND a.dst=m.sq)),
pins AS MATERIALIZED (SELECT m.pos_id, m.sq AS pinner_sq, m.pc AS pinner, c.only_sq AS sq FROM men m JOIN ln l ON l.pc=m.pc AND l.side=m.side AND l.sq=m.sq AND l.dst=m.xking JOIN cov c ON c.pos_id=m.pos_id AND c.sq=m.sq AND c.dst=m.xking
  WHERE m.pc IN (2,3,4) AND c.n=1),
passed AS MATERIALIZED (SELECT p.*, greatest(p.r,2) AS rr, p.sq+1-2*p.side AS stop FROM pawn p WHERE NOT EXISTS (SELECT 1 FROM pawn x WHERE x.pos_id=p.pos_id AND x.side<>p.side AND abs(x.fl-p.fl)<=1 AND (x.rk-p.rk)*(1-2*p.side)>0)
  AND NOT EXISTS (SELECT 1 FROM pawn x WHERE x.pos_id=p.pos_id AND x.side=p.side AND x.fl=p.fl AND (x.rk-p.rk)*(1-2*p.side)>0)),
front AS MATERIALIZED (SELECT p.pos_id, p.side, p.sq, q.s FROM passed p JOIN sqs q ON q.f=p.fl AND (q.r-p.rk)*(1-2*p.side)>0),
unstop AS MATERIALIZED (SELECT p.* FROM passed p WHERE NOT EXISTS (SELECT 1 FROM men x WHERE x.pos_id=p.pos_id AND x.side<>p.side AND x.pc BETWEEN 1 AND 4)
  AND NOT EXISTS (SELECT 1 FROM front t JOIN men x ON x.pos_id=t.pos_id AND x.sq=t.s WHERE t.pos_id=p.pos_id AND t.sq=p.sq)
  AND (7-p.rr+CASE WHEN p.turn<>p.side THEN 1 ELSE 0 END < greatest(abs(p.xking//8-p.fl), abs(p.xking%8-7*(1-p.side)))
    OR NOT EXISTS (SELECT 1 FROM front t WHERE t.pos_id=p.pos_id AND t.sq=p.sq AND NOT EXISTS (SELECT 1 FROM att a WHERE a.pos_id=p.pos_id AND a.side=p.side AND a.pc=5 AND a.dst=t.s)))),
behind AS (SELECT p.pos_id, p.side, p.sq, arg_min(x.pc, abs(x.rk-p.rk)) AS pc, arg_min(x.side, abs(x.rk-p.rk)) AS xside FROM passed p JOIN men x ON x.pos_id=p.pos_id AND x.fl=p.fl AND (x.rk-p.rk)*(1-2*p.side)<0 GROUP BY 1,2,3),
pp AS MATERIALIZED (SELECT p.*, EXISTS (SELECT 1 FROM men x WHERE x.pos_id=p.pos_id AND x.side<>p.side AND x.sq=p.stop) AS held,
  NOT EXISTS (SELECT 1 FROM front t WHERE t.pos_id=p.pos_id AND t.sq=p.sq AND (EXISTS (SELECT 1 FROM men x WHERE x.pos_id=p.pos_id AND x.side<>p.side AND x.sq=t.s) OR NOT EXISTS (SELECT 1 FROM qsafe s WHERE s.pos_id=p.pos_id AND s.side=p.side AND s.s=t.s)))
  AND NOT EXISTS (SELECT 1 FROM behind b WHERE b.pos_id=p.pos_id AND b.sq=p.sq AND b.xside<>p.side AND b.pc IN (3,4)) AS free
  FROM passed p WHERE NOT EXISTS (SELECT 1 FROM unstop u WHERE u.pos_id=p.pos_id AND u.sq=p.sq)),
kingzone_hits AS MATERIALIZED (SELECT a.pos_id, a.side, a.pc, a.sq, a.dst, x.least_pc IS NOT NULL AND x.least_pc<=4 AS guarded FROM att a JOIN zone z ON z.pos_id=a.pos_id AND z.side=1-a.side AND z.s=a.dst
  JOIN psafe s ON s.pos_id=a.pos_id AND s.side=a.side AND s.s=a.dst LEFT JOIN hit x ON x.pos_id=a.pos_id AND x.side=1-a.side AND x.dst=a.dst WHERE a.pc BETWEEN 1 AND 4),
mob AS MATERIALIZED (SELECT m.pos_id, m.side, m.pc, m.sq, m.f, m.r, COUNT(s.s) AS n FROM men m LEFT JOIN att a ON a.pos_id=m.pos_id AND a.sq=m.sq LEFT JOIN psafe s ON s.pos_id=m.pos_id AND s.side=m.side AND s.s=a.dst WHERE m.pc BETWEEN 1 AND 4 GROUP BY ALL),
centre AS (SELECT b.pos_id, CAST(CAST(coalesce(avg(p.fl+0.5), 4) AS FLOAT) AS DOUBLE) AS cf, CAST(CAST(coalesce(avg(p.rk+0.5), 4) AS FLOAT) AS DOUBLE) AS cr FROM pos b LEFT JOIN pawn p USING (pos_id) GROUP BY 1)
"""

_IN_CHECK = "EXISTS (SELECT 1 FROM hit x WHERE x.pos_id=b.pos_id AND x.side=1-b.side AND x.dst=b.king)"

#: (pos_id, side, idx, v) of each family.
FAMILIES = {
    "x1_material": "SELECT pos_id, side, pc AS idx, 1 AS v FROM men WHERE pc<5",
    "x2_bishop_pair": "SELECT pos_id, side, 6 AS idx, 1 AS v FROM men WHERE pc=2 GROUP BY pos_id, side HAVING COUNT(*)>1",
    "x3_piece_square": "SELECT pos_id, side, 7+pc*32+r*4+f AS idx, 1 AS v FROM men",
    "x4_pawn_mobility": "SELECT pos_id, side, 199 AS idx, 1 AS v FROM pawn p WHERE NOT EXISTS (SELECT 1 FROM men m WHERE m.pos_id=p.pos_id AND m.sq=p.sq+1-2*p.side)",
    "x5_piece_mobility": "SELECT pos_id, side, 199+pc*12+f AS idx, CAST(CAST(sqrt(n) AS FLOAT) AS DOUBLE) AS v FROM mob UNION ALL SELECT pos_id, side, 203+pc*12+r, CAST(CAST(sqrt(n) AS FLOAT) AS DOUBLE) FROM mob",
    "x6_pawn_captures": "SELECT a.pos_id, a.side, 271+m.pc AS idx, 1 AS v FROM patt a JOIN men m ON m.pos_id=a.pos_id AND m.sq=a.dst AND m.side<>a.side AND m.pc>0",
    "x7_piece_captures": "SELECT a.pos_id, a.side, 271+a.pc*6+m.pc AS idx, 1 AS v FROM att a JOIN men m ON m.pos_id=a.pos_id AND m.sq=a.dst AND m.side<>a.side WHERE a.pc BETWEEN 1 AND 4 AND NOT (m.pc=0 AND EXISTS (SELECT 1 FROM prot x WHERE x.pos_id=m.pos_id AND x.sq=m.sq))",
    "x8_king_captures": "SELECT a.pos_id, a.side, 301+m.pc AS idx, 1 AS v FROM att a JOIN men m ON m.pos_id=a.pos_id AND m.sq=a.dst AND m.side<>a.side WHERE a.pc=5 AND NOT EXISTS (SELECT 1 FROM prot x WHERE x.pos_id=m.pos_id AND x.sq=m.sq)",
    "x9_safe_checks": "SELECT m.pos_id, m.side, 307+m.pc AS idx, 1 AS v FROM men m JOIN att a ON a.pos_id=m.pos_id AND a.sq=m.sq JOIN qsafe s ON s.pos_id=m.pos_id AND s.side=m.side AND s.s=a.dst JOIN ln l ON l.pc=m.pc AND l.side=m.side AND l.sq=a.dst AND l.dst=m.xking LEFT JOIN cov c ON m.pc>1 AND c.pos_id=m.pos_id AND c.sq=a.dst AND c.dst=m.xking WHERE m.pc BETWEEN 1 AND 4 AND c.n IS NULL AND NOT EXISTS (SELECT 1 FROM men o WHERE o.pos_id=m.pos_id AND o.side=m.side AND o.sq=a.dst) AND NOT EXISTS (SELECT 1 FROM att t WHERE t.pos_id=m.pos_id AND t.sq=m.sq AND t.dst=m.xking)",
    "x10_pinned": "SELECT m.pos_id, m.side, 313+m.pc*6+p.pinner AS idx, 1 AS v FROM men m JOIN pins p ON p.pos_id=m.pos_id AND p.sq=m.sq JOIN men e ON e.pos_id=p.pos_id AND e.sq=p.pinner_sq AND e.side<>m.side WHERE m.pc BETWEEN 1 AND 4 AND (p.pinner<=m.pc OR NOT EXISTS (SELECT 1 FROM att a WHERE a.pos_id=m.pos_id AND a.sq=m.sq AND ((m.fl-m.king//8)*(a.dst%8-m.king%8)=(m.rk-m.king%8)*(a.dst//8-m.king//8)) AND (m.fl-m.king//8)*(a.dst//8-m.king//8)+(m.rk-m.king%8)*(a.dst%8-m.king%8)>0))",
    "x11_king_attack": "SELECT h.pos_id, h.side, 349+((n.n-1)*6+h.pc)*2+CASE WHEN h.guarded THEN 1 ELSE 0 END AS idx, 1 AS v FROM kingzone_hits h JOIN (SELECT pos_id, side, least(COUNT(DISTINCT sq),4) AS n FROM kingzone_hits GROUP BY 1,2) n ON n.pos_id=h.pos_id AND n.side=h.side",
    "x12_pawn_shield": "SELECT p.pos_id, p.side, unnest([397+p.f, 401+p.r]) AS idx, 1 AS v FROM pawn p JOIN zone z ON z.pos_id=p.pos_id AND z.side=p.side AND z.s=p.sq WHERE p.r>=CASE WHEN p.side=0 THEN p.king%8 ELSE 7-p.king%8 END",
    "x13_defended_piece": "SELECT m.pos_id, m.side, unnest([m.f, 4+m.r])+CASE WHEN EXISTS (SELECT 1 FROM prot x WHERE x.pos_id=m.pos_id AND x.sq=m.sq) THEN 409 ELSE 421 END AS idx, 1 AS v FROM men m JOIN hit h ON h.pos_id=m.pos_id AND h.side=m.side AND h.dst=m.sq WHERE m.pc BETWEEN 1 AND 3",
    "x14_minor_outpost": "SELECT m.pos_id, m.side, 433+m.pc*8+m.r AS idx, 1 AS v FROM prot m WHERE m.pc IN (1,2) AND m.f>=2 AND m.r BETWEEN 3 AND 5 AND NOT EXISTS (SELECT 1 FROM xreach x WHERE x.pos_id=m.pos_id AND x.side=m.side AND x.s=m.sq)",
    "x15_bad_bishop": "SELECT m.pos_id, m.side, CASE WHEN p.r<7 AND EXISTS (SELECT 1 FROM shut u WHERE u.pos_id=p.pos_id AND u.side=p.side AND u.s=p.sq+1-2*p.side) THEN 481 ELSE 482 END AS idx, 1 AS v FROM men m JOIN pawn p ON p.pos_id=m.pos_id AND p.side=m.side AND (p.fl+p.rk)%2=(m.fl+m.rk)%2 WHERE m.pc=2",
    "x16_rook_files": "SELECT m.pos_id, m.side, CASE WHEN EXISTS (SELECT 1 FROM pawn p WHERE p.pos_id=m.pos_id AND p.fl=m.fl) THEN 484 ELSE 483 END AS idx, 1 AS v FROM men m WHERE m.pc=3 AND NOT EXISTS (SELECT 1 FROM pawn p WHERE p.pos_id=m.pos_id AND p.side=m.side AND p.fl=m.fl)",
    "x17_trapped_rook": "SELECT m.pos_id, m.side, 485 AS idx, 1 AS v FROM men m WHERE m.pc=3 AND m.r<2 AND m.king%8=7*m.side AND CASE WHEN m.king//8<4 THEN m.fl<=m.king//8 ELSE m.fl>=m.king//8 END AND (SELECT COUNT(*) FROM att a JOIN psafe s ON s.pos_id=a.pos_id AND s.side=a.side AND s.s=a.dst WHERE a.pos_id=m.pos_id AND a.sq=m.sq AND a.dst<>m.king)<3 AND m.rights & CASE m.sq WHEN 56 THEN 1 WHEN 0 THEN 2 WHEN 63 THEN 4 WHEN 7 THEN 8 ELSE 0 END = 0",
    "x18_passed_pawn": "SELECT pos_id, side, 486+rr*20+k AS idx, 1 AS v FROM (SELECT pos_id, side, rr, unnest([0, CASE WHEN held THEN NULL ELSE 1 END, CASE WHEN free THEN 2 END, 4+greatest(abs(king//8-stop//8),abs(king%8-stop%8)), 12+greatest(abs(xking//8-stop//8),abs(xking%8-stop%8))]) AS k FROM pp) WHERE k IS NOT NULL",
    "x20_pawn_structure": "SELECT p.pos_id, p.side, 646+p.r*4+p.f AS idx, 1 AS v FROM pawn p WHERE EXISTS (SELECT 1 FROM pawn x WHERE x.pos_id=p.pos_id AND x.side=p.side AND x.rk=p.rk AND abs(x.fl-p.fl)=1) UNION ALL SELECT p.pos_id, p.side, 678+p.r*4+p.f, 1 FROM prot p WHERE p.pc=0 UNION ALL SELECT p.pos_id, p.side, 710+p.r*4+p.f, 1 FROM pawn p JOIN pawn x ON x.pos_id=p.pos_id AND x.side<>p.side AND x.sq=p.sq+1-2*p.side",
    "x21_weak_pawn": "SELECT pos_id, side, unnest([742+f, 746+r]) AS idx, 1 AS v FROM weak",
    "x22_pawn_centre": "SELECT m.pos_id, m.side, unnest(CASE m.pc WHEN 5 THEN [754,755] ELSE [756,757] END) AS idx, unnest([abs(m.fl+0.5-c.cf), abs(m.rk+0.5-c.cr)]) AS v FROM men m JOIN centre c USING (pos_id) WHERE m.pc IN (1,5)",
    "x23_side_to_move": f"SELECT b.pos_id, b.side, 758 AS idx, 1 AS v FROM both_sides b WHERE b.side=b.turn AND NOT {_IN_CHECK}",
}

ROUNDED = "CAST(ROUND(SUM(v),4) AS DOUBLE)"


def family_sql(name: str) -> str:
    return f"{BASE} SELECT CAST(pos_id AS BIGINT) AS pos_id, CAST(side AS INTEGER) AS side, CAST(idx AS INTEGER) AS idx, {ROUNDED} AS value FROM ({FAMILIES[name]}) GROUP BY 1,2,3 HAVING SUM(v)<>0"


def all_families() -> str:
    return " UNION ALL ".join(f"SELECT pos_id, side, idx, CAST(v AS DOUBLE) AS v FROM ({q})" for q in FAMILIES.values())
