"""Small sources of our own, for the operators that read code rather than tables."""

from __future__ import annotations

FILES = {
    "src/main/java/shop/web/OrderController.java": '''package shop.web;

import org.springframework.web.bind.annotation.*;
import shop.core.OrderService;
import shop.core.OrderError;

@RestController
@RequestMapping("/orders")
public class OrderController {
    private final OrderService service;

    public OrderController(OrderService service) {
        this.service = service;
    }

    @GetMapping("/{id}")
    public String one(@PathVariable long id) {
        return service.find(id);
    }

    @PostMapping
    public void add(String body) throws OrderError {
        service.place(body, 3);
    }

    @ExceptionHandler(OrderError.class)
    public String failed(OrderError e) {
        return "no";
    }
}
''',
    "src/main/java/shop/core/OrderService.java": '''package shop.core;

import shop.data.OrderStore;

@Service
public class OrderService extends BaseService implements Audited {
    @Autowired
    private OrderStore store;

    public String find(long id) {
        log.info("find {}", id);
        return store.load(id);
    }

    public void place(String body, int times) throws OrderError {
        Order made = new Order(body);
        try {
            store.save(made);
            check(made);
            Clock.now();
        } catch (IllegalStateException | OrderError e) {
            throw e;
        }
    }

    @Override
    protected void check(Order o) {
        super.check(o);
        o.touch();
    }

    void main() {
        place("x", 1);
    }
}
''',
    "src/main/java/shop/core/BaseService.java": '''package shop.core;

public abstract class BaseService {
    protected void check(Order o) {
        helper();
        helper(1);
    }

    void helper() { }

    void helper(int n) { }

    void helper(String s) { }
}

interface Audited { }

class Order {
    final String body;

    Order(String body) {
        this.body = body;
    }

    void touch() { }
}

class OrderError extends Exception { }
''',
    "src/main/java/shop/data/OrderStore.java": '''package shop.data;

import shop.core.Order;

@Repository
public interface OrderStore {
    @Query(value = "select o.body from orders o " +
        "join customers c on c.id = o.customer_id where o.id = ?1", nativeQuery = true)
    String load(long id);

    @Query("select o from Order o where o.body = :body")
    Order byBody(String body);

    default void save(Order o) {
        jdbc.update("INSERT INTO orders (body) VALUES (?)", o);
    }
}
''',
    "src/main/java/shop/batch/DailyJob.java": '''package shop.batch;

import org.apache.spark.sql.Dataset;
import org.apache.spark.sql.SparkSession;

public class DailyJob {
    public static void main(String[] args) {
        run(SparkSession.builder().getOrCreate());
    }

    static void run(SparkSession spark) {
        Dataset<Row> sales = spark.table("Raw.Sales").filter("amount > 0");
        Dataset<Row> people = spark.sql("""
            SELECT id, name FROM people
            """);
        sales.join(people, "id").groupBy("name").count().write().saveAsTable("mart.daily");
        sales.write().parquet("s3://bucket/daily");
    }
}
''',
    "db/schema.sql": """-- tables
CREATE TABLE orders (id BIGSERIAL, body TEXT);

INSERT INTO orders SELECT * FROM staging.orders_in;
-- only a comment
;
DELETE FROM old_orders
""",
    "src/main/resources/application.yml": "db:\n  url: jdbc:x\n  password: hunter2\nports:\n  - 80\n  - name: a\n",
    "src/main/resources/extra.properties": "# note\na.b = 1\napi_key: k1\nempty=\nno separator\nurl=http://h:1\n",
    "pom.xml": """<project xmlns="http://maven.apache.org/POM/4.0.0"><parent><groupId>org.springframework.boot</groupId>
<artifactId>spring-boot-starter-parent</artifactId><version>3.2.1</version></parent><artifactId>shop</artifactId>
<properties><java.version>21</java.version><spark>4.0.0</spark></properties><dependencies>
<dependency><groupId>org.apache.spark</groupId><artifactId>spark-sql_2.13</artifactId><version>${spark}</version></dependency>
<dependency><groupId>org.postgresql</groupId><artifactId>postgresql</artifactId></dependency>
<dependency><groupId>org.junit.jupiter</groupId><artifactId>junit-jupiter</artifactId><version>5.1</version></dependency>
</dependencies></project>""",
}

DIFF = """diff --git a/src/A.java b/src/A.java
index 1..2 100644
--- a/src/A.java
+++ b/src/A.java
@@ -3 +3,2 @@ class A
-old
+new
+more
@@ -10,2 +12,0 @@
-x
-y
diff --git a/src/B.java b/src/C.java
similarity index 100%
rename from src/B.java
rename to src/C.java
diff --git a/new.sql b/new.sql
new file mode 100644
--- /dev/null
+++ b/new.sql
@@ -0,0 +1 @@
+select 1
diff --git a/gone.txt b/gone.txt
deleted file mode 100644
--- a/gone.txt
+++ /dev/null
@@ -1 +0,0 @@
-bye
"""
