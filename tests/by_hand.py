"""Literal Java sources of the code queries, and the rows that reading them by hand gives."""

JAVA = [
    ("web/OrderController.java", """package shop.web;
import shop.svc.OrderService;
@RestController
@RequestMapping("/orders")
public class OrderController {
    private final OrderService service;
    // service.fake();
    @GetMapping("/{id}")
    public Order find(Long id) {
        log("/* not a comment */ find(");
        return service.load(id);
    }
    @PostMapping
    public void add(Order order, Pageable page) {
        Checker<Order> checker = new Checker<>();
        if (checker.valid(order)) { this.service.save(order); }
    }
}
"""),
    ("svc/OrderService.java", """package shop.svc;
public interface OrderService {
    Order load(Long id);
    void save(Order order);
}
"""),
    ("svc/OrderServiceImpl.java", """package shop.svc;
import shop.db.OrderMapper;
@Service
public class OrderServiceImpl extends BaseService implements shop.svc.OrderService {
    @Autowired private OrderMapper mapper;
    public Order load(Long id) { return mapper.select(id).orElse(new Fallback().make()); }
    public void save(Order order) { audit(order); mapper.insert(order); retry(order); }
    void retry(Order order) { save(order); }
}
"""),
    ("db/OrderMapper.java", """package shop.db;
@Mapper
public interface OrderMapper {
    Optional<Order> select(Long id);
    int insert(Order order);
    List<Order> all();
}
"""),
    ("svc/BaseService.java", """package shop.svc;
abstract class BaseService extends Object {
    protected void audit(Object what) { }
}
"""),
]

#: (path, class_name, kind, superclass, interfaces)
CLASSES = [
    ("web/OrderController.java", "OrderController", "class", "", ""),
    ("svc/OrderService.java", "OrderService", "interface", "", ""),
    ("svc/OrderServiceImpl.java", "OrderServiceImpl", "class", "BaseService", "shop.svc.OrderService"),
    ("db/OrderMapper.java", "OrderMapper", "interface", "", ""),
    ("svc/BaseService.java", "BaseService", "class", "Object", ""),
]
#: (class_name, name, return_type, params, calls, start_line, end_line)
METHODS = [
    ("OrderController", "find", "Order", "Long id", "log service.load", 8, 12),
    ("OrderController", "add", "void", "Order order,Pageable page", "checker.valid service.save", 13, 17),
    ("OrderService", "load", "Order", "Long id", "", 3, 3),
    ("OrderService", "save", "void", "Order order", "", 4, 4),
    ("OrderServiceImpl", "load", "Order", "Long id", "mapper.select mapper.orElse Fallback.make", 6, 6),
    ("OrderServiceImpl", "save", "void", "Order order", "audit mapper.insert retry", 7, 7),
    ("OrderServiceImpl", "retry", "void", "Order order", "save", 8, 8),
    ("OrderMapper", "select", "Optional<Order>", "Long id", "", 4, 4),
    ("OrderMapper", "insert", "int", "Order order", "", 5, 5),
    ("OrderMapper", "all", "List<Order>", "", "", 6, 6),
    ("BaseService", "audit", "void", "Object what", "", 3, 3),
]
#: (caller, callee, callee_file), without interfaces expanded
EDGES = [
    ("OrderController.find", "OrderController.log", "web/OrderController.java"),
    ("OrderController.find", "OrderService.load", "svc/OrderService.java"),
    ("OrderController.add", "Checker.valid", "web/OrderController.java"),
    ("OrderController.add", "OrderService.save", "svc/OrderService.java"),
    ("OrderServiceImpl.load", "OrderMapper.select", "db/OrderMapper.java"),
    ("OrderServiceImpl.load", "OrderMapper.orElse", "db/OrderMapper.java"),
    ("OrderServiceImpl.load", "Fallback.make", "svc/OrderServiceImpl.java"),
    ("OrderServiceImpl.save", "OrderServiceImpl.audit", "svc/OrderServiceImpl.java"),
    ("OrderServiceImpl.save", "OrderMapper.insert", "db/OrderMapper.java"),
    ("OrderServiceImpl.save", "OrderServiceImpl.retry", "svc/OrderServiceImpl.java"),
    ("OrderServiceImpl.retry", "OrderServiceImpl.save", "svc/OrderServiceImpl.java"),
]
#: what expanding interfaces adds
MORE_EDGES = [
    ("OrderController.find", "OrderServiceImpl.load", "svc/OrderServiceImpl.java"),
    ("OrderController.add", "OrderServiceImpl.save", "svc/OrderServiceImpl.java"),
]
#: (class_name, layer)
CLASS_LAYERS = [("OrderController", "Controller"), ("OrderService", "Service"), ("OrderServiceImpl", "Service"), ("OrderMapper", "Mapper"), ("BaseService", "Service")]
#: (class_name, name, data_type)
DATA_TYPES = [
    ("OrderController", "find", "single"), ("OrderController", "add", "paged_list"), ("OrderService", "load", "single"), ("OrderService", "save", "single"),
    ("OrderServiceImpl", "load", "single"), ("OrderServiceImpl", "save", "single"), ("OrderServiceImpl", "retry", "single"), ("OrderMapper", "select", "single"),
    ("OrderMapper", "insert", "single"), ("OrderMapper", "all", "unpaged_list"), ("BaseService", "audit", "single"),
]
#: (sql_id, sql)
SELECTS = [
    ("q1", "SELECT a.NAME AS n, (SELECT max(x) FROM t2) top, COUNT(*), f(a, 'x, FROM y') g, a.AGE FROM t a WHERE z = 1"),
    ("q2", "select distinct NAME nm, '--no' c -- AGE\n from t"),
    ("q3", "SELECT * FROM t"),
    ("q4", "UPDATE t SET a = 1"),
    ("q5", "SELECT enc(b.AGE) AS age2, NAMES FROM b"),
]
#: (sql_id, column, alias) of each item; empty: none
ITEMS = [
    ("q1", "NAME", "n"), ("q1", "", "top"), ("q1", "", ""), ("q1", "", "g"), ("q1", "AGE", ""), ("q2", "NAME", "nm"), ("q2", "", "c"), ("q3", "", ""), ("q5", "", "age2"), ("q5", "NAMES", ""),
]
#: (sql_id, column, alias) of items that hold NAME or AGE
TARGETS = [("q1", "NAME", "n"), ("q1", "AGE", "AGE"), ("q2", "NAME", "nm"), ("q5", "AGE", "age2")]

#: Methods that call a utility, its signatures, and the calls by loop depth: outside, in one, in more, the deepest, all.
CRYPTO_NAMES = ["com.shop.CipherUtil.encrypt(String) -> String", "CipherUtil.decryptAll", "CipherUtil.name"]
CRYPTO_CODE = [
    ("plain", "String f(String s) { return CipherUtil.encrypt(s); }"),
    ("commented", "void f() { /* CipherUtil.encrypt(a) */ log(\"CipherUtil.encrypt(b)\"); // CipherUtil.encrypt(c)\n }"),
    ("loops", "void f() { for (A a : all) { CipherUtil . encrypt(a.x); while (a.next()) { CipherUtil.decryptAll(a); for (;;) { CipherUtil.encrypt(a); } } } CipherUtil.encrypt(z); CipherUtil.name(z); }"),
]
CRYPTO_DEPTHS = [("plain", 1, 0, 0, 0, 1), ("commented", 0, 0, 0, 0, 0), ("loops", 1, 1, 2, 3, 4)]

#: Statements and the watched columns of the SQL text tests.
STATEMENTS = [
    ("s01", "CustomerMapper.xml", "SELECT c_name, c_acctbal FROM customer WHERE c_custkey = #{id}"),
    ("s02", "CustomerMapper.xml", "SELECT * FROM customer"),
    ("s03", "CustomerMapper.xml", "SELECT c.c_name, o.o_totalprice FROM customer c INNER JOIN orders o ON c.c_custkey = o.o_custkey"),
    ("s04", "OrderMapper.xml", "select o.o_orderkey, c.c_name from sales.orders o left join sales.customer c on o.o_custkey = c.c_custkey where o.o_orderstatus = #{status}"),
    ("s05", "OrderMapper.xml", "SELECT o.o_totalprice, l.l_quantity FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey JOIN part p ON l.l_partkey = p.p_partkey"),
    ("s06", "OrderDao.java", "INSERT INTO orders (o_orderkey, o_totalprice) VALUES (#{key}, #{price})"),
    ("s07", "CustomerDao.java", "UPDATE customer SET c_name = #{name}, c_acctbal = ${bal} WHERE c_custkey = #{id}"),
    ("s08", "OrderDao.java", "DELETE FROM orders WHERE o_orderkey = #{key}"),
    ("s09", "PartMapper.xml", "/* names */ SELECT p_name -- only\n FROM part"),
    ("s10", "SupplierMapper.xml", "SELECT s_suppkey, s_name FROM supplier"),
    ("s11", "SupplierMapper.xml", "SELECT s.s_name, n.n_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"),
    ("s12", "RegionMapper.xml", "SELECT x FROM (SELECT r_name AS x FROM region) t"),
    ("s13", "CustomerDao.java", "SELECT C_NAME FROM CUSTOMER WHERE C_MKTSEGMENT = ${segment}"),
    ("s14", "OtherDao.java", "SELECT id FROM audit_log"),
    ("s15", "OrderMapper.xml", "SELECT o.o_orderdate FROM orders AS o WHERE o.o_orderkey IN (#{key})"),
    ("s16", "BatchDao.java", "MERGE INTO orders USING staging ON 1 = 1"),
]
#: (table, column, whether it is a new column)
WATCHED = [("CUSTOMER", "C_NAME", False), ("CUSTOMER", "C_ACCTBAL", True), ("ORDERS", "O_TOTALPRICE", False), ("SUPPLIER", "S_NAME", True)]
#: (file, layer, position)
LAYERS = [("CustomerMapper.xml", "mapper", 1), ("OrderMapper.xml", "mapper", 2), ("OrderDao.java", "dao", 3), ("CustomerDao.java", "dao", 4), ("PartMapper.xml", "mapper", 5), ("SupplierMapper.xml", "mapper", 6), ("RegionMapper.xml", "mapper", 7), ("OtherDao.java", "dao", 8), ("BatchDao.java", "batch", 9)]
