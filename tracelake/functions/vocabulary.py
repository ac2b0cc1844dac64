"""Word lists and tables that results depend on. All are fixed values."""

from __future__ import annotations

#: Hosts that name no service of a fleet.
NOISE_HOSTS = (
    "localhost", "127.0.0.1", "0.0.0.0", "example.com", "example.org", "test.com", "foo.com", "test.local", "playwright.dev",
    "www.w3.org", "schemas.xmlsoap.org", "swagger.io", "www.google.com", "google.com", "motoapi.amazonaws.com",
)
#: Path segments that say which layer is addressed, not what.
GENERIC_SEGMENTS = ("api", "rest", "internal", "public", "service", "services")
#: Path segments that name an operation.
OPERATION_SEGMENTS = (
    "create", "update", "delete", "remove", "add", "save", "edit", "put", "patch",
    "get", "fetch", "read", "list", "all", "search", "find", "query", "count",
)
#: Routes that many services share.
NOISE_PATHS = ("/metrics", "/health", "/healthz", "/ready", "/live", "/actuator", "/swagger", "/openapi", "/api/health", "/status")

#: Call names that execute SQL, and those of object mappers.
SQL_EXECUTION_NAMES = (
    "execute", "executeQuery", "executeUpdate", "executeBatch", "query", "update", "batchUpdate",
    "createQuery", "createNativeQuery", "getResultList", "raw", "Exec", "Query", "QueryRow", "Queryx",
)
SQL_ORM_NAMES = ("find", "findOne", "insert", "insertOne", "save", "delete", "deleteOne", "aggregate", "exec")
#: Receivers that are database handles.
DATABASE_RECEIVERS = (
    "jdbctemplate", "namedparameterjdbctemplate", "entitymanager", "em", "session", "sqlsession", "cursor", "conn", "connection", "stmt",
    "statement", "preparedstatement", "ps", "pstmt", "cstmt", "callablestatement", "db", "dao", "repository", "tx", "datasource", "querydsl",
)
#: Receivers that are known to be something else.
OTHER_RECEIVERS = (
    "httpclient", "resttemplate", "webclient", "restclient", "okhttpclient", "messagedigest", "digest", "cipher", "mac", "signature",
    "executor", "executorservice", "threadpool", "pool", "scheduler", "cache", "logger",
)
#: Text of a call that names a SQL library.
SQL_CALL_HINTS = (
    "JdbcTemplate", "NamedParameterJdbcTemplate", "createNativeQuery", "createQuery", "PreparedStatement", "Statement.", "executeQuery",
    "SqlSession", "session.execute", "cursor.execute", "db.execute",
)

#: A field's canonical key.
FIELD_ALIASES = {
    "phonenumber": "phone", "phone_number": "phone", "telephone": "phone", "mobile": "phone", "emailaddress": "email", "e_mail": "email",
    "firstname": "first_name", "lastname": "last_name", "fullname": "full_name", "dateofbirth": "date_of_birth", "birthdate": "date_of_birth",
    "ipaddress": "ip_address", "useragent": "user_agent",
}
#: Field names (any case) that hold personal data, as they are scanned for.
PII_FIELDS = (
    "email", "emailAddress", "e_mail", "phone", "phoneNumber", "phone_number", "telephone", "mobile", "firstName", "first_name", "lastName",
    "last_name", "fullName", "full_name", "birthDate", "dateOfBirth", "date_of_birth", "dob", "ssn", "socialSecurityNumber", "socialSecurity",
    "nationalId", "national_id", "address", "streetAddress", "street_address", "postalCode", "postal_code", "zipCode", "zip_code", "creditCard",
    "credit_card", "cardNumber", "card_number", "cvv", "cvc", "iban", "sortCode", "sort_code", "accountNumber", "account_number", "passport",
    "passportNumber", "passport_number", "driverLicense", "driver_license", "taxId", "tax_id", "vatNumber", "vat_number", "ipAddress",
    "ip_address", "userAgent", "user_agent", "gender", "race", "ethnicity", "religion", "politicalOpinion", "medicalRecord", "medical_record",
    "healthCondition", "prescription", "biometric", "fingerprint", "faceId", "face_id",
)
#: The class of a field's lower-cased name, by class.
PII_CLASSES = {
    "direct-pii": (
        "email", "emailaddress", "phone", "phonenumber", "phone_number", "telephone", "mobile", "firstname", "first_name", "lastname",
        "last_name", "fullname", "full_name", "address", "streetaddress", "postalcode", "zipcode",
    ),
    "sensitive": (
        "ssn", "socialsecuritynumber", "creditcard", "cardnumber", "cvv", "cvc", "iban", "accountnumber", "passport", "passportnumber",
        "driverlicense", "taxid", "vatnumber",
    ),
    "special-category-gdpr": (
        "gender", "race", "ethnicity", "religion", "politicalopinion", "medicalrecord", "healthcondition", "prescription", "biometric",
        "fingerprint", "faceid", "dob", "dateofbirth", "birthdate",
    ),
    "quasi-id": ("ipaddress", "useragent"),
}
#: The business class of a field's lower-cased name, by class.
DATA_CLASSES = {
    "tenant-content": ("messagebody", "message_body", "scannedmessage", "attachmentcontent", "scannedattachment", "scannedurl"),
    "tenant-metadata": ("messageheader",),
    "tenant-config": ("policyconfig", "customerpolicy"),
    "tenant-content-classified": ("dlpclassification",),
    "tenant-derived": ("sandboxverdict",),
    "credential": ("apikey", "api_key", "customerapikey", "bearertoken", "refresh_token", "refreshtoken", "totpsecret", "smtppassword"),
    "credential-derived": ("datakey", "kmskey"),
    "dangerous-payload": ("sql", "query", "dql", "cypher", "soql", "statement", "expression", "script", "command", "jsonpath", "xpath"),
}
#: Field names (any case) of tenant data and credentials, as they are scanned for.
TENANT_FIELDS = (
    "messageBody", "message_body", "scannedMessage", "scanned_message", "attachmentContent", "attachment_content", "scannedAttachment",
    "scannedUrl", "scanned_url", "messageHeader", "message_header", "policyConfig", "policy_config", "customerPolicy", "dlpClassification",
    "sandboxVerdict", "sandbox_verdict", "apiKey", "api_key", "customerApiKey", "bearerToken", "bearer_token", "refreshToken", "refresh_token",
    "dataKey", "data_key", "kmsKey", "totpSecret", "smtpPassword", "smtp_password",
)
#: Field names that carry statements to run.
RAW_SQL_FIELDS = ("sql", "rawSql", "raw_sql", "nativeQuery", "native_query", "dql", "cypher", "soql", "statement", "soqlQuery", "soql_query")

#: Categories of processing records by class of personal data.
ROPA_CATEGORIES = {
    "direct-pii": "Contact and identity data",
    "sensitive": "Financial and government identifiers",
    "special-category-gdpr": "Special category personal data",
    "quasi-id": "Online identifiers and technical data",
}
ROPA_UNKNOWN = "Unclassified personal data"

WEAK_CARD_ALGORITHMS = ("MD5", "SHA1", "SHA-1", "DES", "RC4", "3DES", "ECB")
CLIENT_SUFFIXES = ("-client", "-api-client", "-rest-client", "-client-java", "-java-client", "-sdk", "-sdk-java")
MAX_PATTERN_REPOS = 3
#: Prefixes of coordinates that no organisation's own artifacts have.
EXTERNAL_PREFIXES = (
    "org.springframework", "org.apache", "org.jetbrains", "io.netty", "io.micronaut", "io.quarkus", "com.fasterxml", "com.google",
    "javax.", "jakarta.", "junit", "org.junit", "io.projectreactor", "org.slf4j", "ch.qos", "org.testcontainers", "org.mockito",
    "io.swagger", "io.opentelemetry", "io.dropwizard", "io.vertx", "org.eclipse", "redis.clients",
)
WEAK_ALGORITHMS = ("MD5", "MD4", "SHA1", "SHA-1", "DES", "RC4", "RC2", "BLOWFISH")
