"""Sources, parsers and outside calls on small generated trees with exact expected rows."""

import pytest
from pyspark.sql import functions as F

from lineloom.functions import javatext
from lineloom.operators import external, matching
from lineloom.sources import files, mapper

JAVA = """package a.b;
@RestController
@RequestMapping("/api/users")
public class UserController {
    private String url = "http://x"; // @GetMapping("/no")
    @GetMapping("/{id}")
    public User find(Long id) { return null; }
    @PostMapping
    @Valid
    public List<User> add() { return null; }
    @RequestMapping(value = "all/", method = RequestMethod.PUT)
    public void all() { }
}
"""
XML = """<?xml version="1.0"?>
<!DOCTYPE mapper PUBLIC "-//x//DTD" "http://example.invalid/x.dtd">
<mapper namespace="a.UserMapper">
  <sql id="cols">id, name</sql>
  <resultMap id="m" type="User"><id property="id" column="ID"/><result property="name" column="NAME"/></resultMap>
  <insert id="put">INSERT INTO users (id) VALUES (#{id})</insert>
  <select id="get" resultMap="m">SELECT <include refid="cols"/> <!-- c --> FROM users
    <where><if test="a">AND id = #{id}</if></where></select>
  <update id="set">UPDATE users <set><if test="n">name = #{n},</if></set> WHERE id IN <foreach open="(" close=")">#{i}</foreach></update>
  <select id="pick">SELECT 1 <choose><when test="a">A</when><otherwise>B</otherwise></choose><trim prefix="P" prefixOverrides="AND|OR"> and x </trim><include refid="gone"/></select>
  <delete id="none"> </delete><select>SELECT 2</select>
</mapper>"""


@pytest.fixture()
def tree(tmp_path):
    for name, text in {"src/UserController.java": JAVA, "src/UserMapper.XML": XML, "build/X.java": "x", "src/.h/Y.java": "y", "src/UserTest.java": "t", "notes.txt": "n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def test_scan(spark, tree):
    got = files.scan(spark, str(tree), exclude_files=["*Test.java"])
    assert sorted(tuple(r) for r in got.select("relative_path", "filename", "extension", "size").collect()) == [
        ("src/UserController.java", "UserController.java", ".java", len(JAVA)), ("src/UserMapper.XML", "UserMapper.XML", ".XML", len(XML)),
    ]
    cache = got.where("extension = '.XML'")
    assert [r.filename for r in files.to_parse(got, cache).collect()] == ["UserController.java"]
    texts = files.scan(spark, str(tree), content=True).where("extension = '.XML'").select(files.text(F.col("content")).alias("t"))
    assert texts.first().t == XML


def test_decoding(spark):
    rows = [("가나".encode("euc-kr"),), ("가나".encode(),), (b"\xff\xfe\xff",), (None,), (b"",)]
    got = [r.t for r in spark.createDataFrame(rows, "b binary").select(files.text(F.col("b")).alias("t")).collect()]
    assert got == ["가나", "가나", b"\xff\xfe\xff".decode("latin-1"), None, ""]


def test_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_text("/x, 3\n\n/y 4\n/z,bad\n/x,5\nalone\n")
    assert {tuple(r) for r in files.access_counts(spark, str(tmp_path / "a.txt")).collect()} == {("/x", 5), ("/y", 4)}
    (tmp_path / "b.txt").write_text("\ufeff/src//A.java\n# no\n\nsrc/B.java\n")
    assert {r[0] for r in files.changed_files(spark, str(tmp_path / "b.txt")).collect()} == {"src/A.java", "src/B.java"}
    df = spark.createDataFrame([("1", "a"), ("2", "b"), (None, "c")], "ts string, v string")
    assert [r.v for r in files.latest(df).collect()] == ["b"]
    files.save(df, str(tmp_path / "t"))
    assert files.load(spark, str(tmp_path / "t"), "ts string, v string").count() == 3


def test_mapper(spark):
    rows = mapper.statements(spark.createDataFrame([("m.xml", XML), ("bad.xml", "<a"), ("null.xml", None)], "path string, text string")).collect()
    got = {r.sql_id: r for r in rows if r.sql_id}
    assert [r.sql_id for r in rows if r.sql_id] == ["get", "pick", "put", "set"]
    assert got["get"].sql == "SELECT FROM users AND id = #{id}" and got["get"].result_type == "User"
    assert got["get"].resolved == "SELECT id, name FROM users WHERE id = #{id}"
    assert [tuple(x) for x in got["get"].mappings] == [("name", "NAME"), ("id", "ID")]
    assert got["set"].resolved == "UPDATE users SET name = #{n} WHERE id IN ( #{i} )"
    assert got["pick"].resolved == "SELECT 1 A P x /* MISSING INCLUDE: gone */"
    assert {r.path for r in rows if r.error} == {"bad.xml", "null.xml"}


def test_java(spark):
    df = spark.createDataFrame([("a", JAVA), ("n", None), ("e", "")], "path string, text string")
    assert {tuple(r) for r in javatext.endpoints(df).collect()} == {
        ("a", "UserController", "find", "GET", "/api/users/{id}"), ("a", "UserController", "add", "POST", "/api/users"), ("a", "UserController", "all", "PUT", "/api/users/all"),
    }
    src = 'x = "a // b /* c */"; // gone\n/* gone\n */ y = \'"\'; // "gone"'
    assert spark.createDataFrame([(src,)], "s string").select(javatext.without_comments(F.col("s"))).first()[0] == 'x = "a // b /* c */"; \n y = \'"\'; '
    code = 'c.prepareStatement("SELECT 1"); @Query(value = "FROM U") em.createNativeQuery("SELECT 2"); sqlB.append("SELECT\\n"); sqlB.append("3"); sqlB.toString();'
    assert {tuple(r)[1:] for r in javatext.embedded_sql(spark.createDataFrame([("a", code)], "path string, text string")).collect()} == {
        ("jdbc", "SELECT 1"), ("jpa_query", "FROM U"), ("jpa_create", "SELECT 2"), ("builder", "SELECT 3"),
    }
    kinds = spark.createDataFrame([("Map<K, V>",), ("void",), ("User",), (None,), ("int[]",)], "k string")
    got = [tuple(r) for r in kinds.select(javatext.inner_type(F.col("k")), javatext.cardinality(F.col("k"))).collect()]
    assert got == [("V", "multiple"), ("void", "none"), ("User", "single"), (None, "none"), ("int[]", "multiple")]


def test_calls_and_changes(spark):
    def provider(p):
        if p == "bad":
            raise ValueError
        return "echo: " + p

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bad"), (4, None)], "i int, q string")
    got = {r.i: (r.content, r.tokens) for r in external.call(df, "q", provider, retries=1, first_wait=0.01).collect()}
    assert got == {1: ("echo: a", 1), 2: ("echo: a", 1), 3: (None, None), 4: (None, None)}
    assert [r[0] for r in df.select(external.render("<{i}:{q}>", i="i", q="q")).collect()] == ["<1:a>", "<2:a>", "<3:bad>", "<4:>"]
    d = spark.createDataFrame([("a\nb\nc", "a\nx\nc\nd"), (None, None)], "o string, n string")
    assert [[tuple(x) for x in r.changes] for r in matching.line_changes(d, "o", "n").collect()] == [[("replace", 1, 2, 1, 2), ("insert", 3, 3, 3, 4)], []]
