"""Patterns that scanned text is matched with. All are fixed values: what they match decides results."""

from __future__ import annotations

import re

_I, _M = re.IGNORECASE, re.MULTILINE

#: (pattern, framework, groups hold a method first) by languages.
HTTP_IN = {
    ("java", "kotlin"): [
        (r'@(GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping|RequestMapping)\s*\(\s*(?:value\s*=\s*)?(?:\{?\s*)?"([^"]*)"', "spring"),
        (r'@(?:Get|Post|Put|Delete|Patch)\s*\(\s*(?:uri\s*=\s*)?"([^"]*)"', "jax-rs"),
        (r'@Path\s*\(\s*"([^"]+)"', "jax-rs"),
    ],
    ("python",): [
        (r'@app\.route\s*\(\s*["\']([^"\']+)["\']', "flask"),
        (r'@router\.(get|post|put|delete|patch)\s*\(\s*["\']([^"\']+)["\']', "fastapi"),
    ],
    ("javascript", "typescript", "tsx"): [
        (r'\b(?:app|router|server|api|fastify|_router|[A-Za-z_$][\w$]*[Rr]outer)\s*\.\s*(get|post|put|delete|patch)\s*\(\s*["\']([^"\']+)["\']', "express"),
    ],
    ("go",): [(r'\.(GET|POST|PUT|DELETE|PATCH)\s*\(\s*"([^"]+)"', "gin")],
}
#: Frameworks whose pattern is anchored to nothing that declares a route.
UNANCHORED = ("gin",)

FILE_SINKS = [
    (r"Files\.(write|writeString|delete|move|copy)\s*\(", "java-nio"),
    (r"new\s+FileOutputStream\s*\(", "java-io"),
    (r"FileWriter\s*\(", "java-io"),
    (r"ZipInputStream|TarArchiveInputStream", "archive-extract"),
    (r"fs\.(writeFile|writeFileSync|createWriteStream|unlink)\s*\(", "node-fs"),
    (r"open\s*\([^)]*['\"][wa]", "python-open"),
    (r"Path\.(write_text|write_bytes|unlink)\s*\(", "python-pathlib"),
    (r"shutil\.(copy|move|rmtree)\s*\(", "python-shutil"),
    (r"os\.(Create|Remove|Rename)\s*\(", "go-os"),
    (r"ioutil\.WriteFile\s*\(", "go-ioutil"),
]

#: Calls that are outbound wherever they stand.
HTTP_OUT = [
    r"\b[A-Za-z_]\w*\s*\.\s*(getForObject|getForEntity|postForObject|postForEntity|postForLocation|patchForObject|putForObject|exchange)\s*\(",
    r"\b(?:[Rr]est[Tt]emplate|[Ww]eb[Cc]lient|[Hh]ttp[Cc]lient|[Ff]eign[Cc]lient|[Oo]k[Hh]ttp[Cc]lient)\s*\.\s*(get|post|put|delete|patch|head|options|method|uri)\s*\(",
    r"[Ww]eb[Cc]lient\.(create|builder)",
    r"[Ww]eb[Cc]lient\.[a-zA-Z]+\(\)\.(get|post|put|delete|patch)",
    r"OkHttpClient|\.newCall\s*\(",
    r"HttpClient\.(newHttpClient|send|sendAsync)",
    r"HttpRequest\.newBuilder",
    r"URI\.create\s*\(",
    r"@(?:FeignClient|HttpExchange)\s*\(",
    r"@(?:Get|Post|Put|Delete|Patch)Exchange\s*\(\s*[\"']([^\"']+)[\"']",
    r"requests\.(get|post|put|delete|patch)\s*\(",
    r"httpx\.(get|post|put|delete|patch|AsyncClient)",
    r"aiohttp\.ClientSession",
    r"urllib\.request\.urlopen\s*\(",
    r"http\.client\.HTTPConnection|urllib3",
    r"\bfetch\s*\(",
    r"axios\.(get|post|put|delete|patch)",
    r"http\.NewRequest\s*\(",
]
_PY_HTTP = r"\b(?:requests|httpx|aiohttp|urllib3|urlopen|HTTPConnection)\b|base_url|raise_for_status|\bSession\s*\(|\b(?:status_code|Authorization|Bearer|content_type|application/json)\b"
_JAVA_HTTP = r"\b(?:RestTemplate|WebClient|OkHttpClient|HttpClient|HttpEntity|HttpHeaders|ResponseEntity|HttpMethod|FeignClient|WebTarget|MediaType|HttpStatus|Authorization|Bearer)\b"
#: (call, languages, what the file must hold).
HTTP_OUT_GUARDED = [
    (r"\bself\s*\.\s*(get|post|put|delete|patch)\s*\(", ("python",), _PY_HTTP),
    (r"\b(?:session|_session|client|_client|http|_http)\s*\.\s*(get|post|put|delete|patch)\s*\(", ("python",), _PY_HTTP),
    (r"\b\w*[Cc]lient\s*\.\s*(get|post|put|delete|patch|call|send|execute)\s*\(", ("java", "kotlin"), _JAVA_HTTP),
]
CONFIG_PLACEHOLDER = re.compile(r"\$\{([A-Za-z0-9_.\-]{1,120})[^}\n]{0,80}\}")

#: (pattern, direction, system).
QUEUES = [
    (r'@KafkaListener[^)]*topics\s*=\s*"([^"]+)"', "consume", "kafka"),
    (r'kafkaTemplate\.send\s*\(\s*"([^"]+)"', "produce", "kafka"),
    (r'@RabbitListener[^)]*queues\s*=\s*"([^"]+)"', "consume", "rabbitmq"),
    (r'rabbitTemplate\.(convertAndSend|send)\s*\(\s*"([^"]+)"', "produce", "rabbitmq"),
    (r'@SqsListener\s*\(\s*"([^"]+)"', "consume", "sqs"),
    (r"sqsClient\.sendMessage", "produce", "sqs"),
    (r"redisTemplate\.opsForStream\(\)\.add", "produce", "redis-stream"),
    (r'\.publish\s*\(\s*"([^"]+)"', "produce", "nats"),
    (r"SnsClient\.publish", "produce", "sns"),
    (r"@JmsListener", "consume", "jms"),
]

CRYPTO = [
    (r'MessageDigest\.getInstance\s*\(\s*"([^"]+)"', "hash"),
    (r'Cipher\.getInstance\s*\(\s*"([^"]+)"', "cipher"),
    (r"BCryptPasswordEncoder|Argon2PasswordEncoder", "password-hash"),
    (r"hashlib\.(md5|sha1|sha256)", "hash"),
    (r"crypto\.create(Hash|Cipheriv|Hmac)", "node-crypto"),
]
KEY_SOURCES = [
    (r"SecretsManagerClient|getSecretValue", "aws-secrets-manager"),
    (r"KmsClient|generateDataKey|\.decrypt\s*\(", "aws-kms"),
    (r"SsmClient|getParameter", "aws-parameter-store"),
    (r"Vault\.|VaultTemplate", "hashicorp-vault"),
    (r"SecretManagerServiceClient|accessSecretVersion", "gcp-secret-manager"),
    (r"SecretClient\.getSecret", "azure-key-vault"),
]
AUTH = [
    (r"@PreAuthorize", "spring-pre-authorize"),
    (r"@Secured\s*\(\s*\{\s*\"ROLE_ANONYMOUS\"", "secured-anonymous"),
    (r"@Secured\s*\(\s*\{\s*\"ROLE_", "secured-role"),
    (r"IS_AUTHENTICATED", "secured-authenticated"),
    (r"@PermitAll", "permit-all"),
    (r"@RolesAllowed", "jaxrs-roles-allowed"),
    (r"csrf\(\)\.disable", "csrf-disabled"),
]
#: (pattern, mechanism, someone outside can trigger it).
ENTRY_MARKERS = [
    (r"@GrpcService\b", "grpc", True),
    (r"\bextends\s+\w{1,80}Grpc\.\w{1,80}ImplBase\b", "grpc", True),
    (r"@(?:GRpcService|GrpcAdvice)\b", "grpc", True),
    (r"@(?:QueryMapping|MutationMapping|SubscriptionMapping)\b", "graphql", True),
    (r"@Dgs(?:Query|Mutation|Subscription|Data)\b", "graphql", True),
    (r"@SchemaMapping\b", "graphql", True),
    (r"@Scheduled\b", "schedule", False),
    (r"@DisallowConcurrentExecution\b", "schedule", False),
    (r"@app\.task\b", "schedule", False),
    (r"\bargparse\.ArgumentParser\s*\(", "cli", True),
    (r"\bsys\.argv\b", "cli", True),
    (r"\bpublic\s+static\s+void\s+main\s*\(\s*String\s*(?:\[\]\s*\w{1,80}|\w{1,80}\s*\[\])", "cli", True),
    (r"@click\.command\b", "cli", True),
    (r"@FileWatch\b|\bWatchService\b", "file-watch", True),
]
PII_LOG = re.compile(r"(?:log(?:ger)?|LOG)\.(?:info|warn|error|debug|trace)\s*\(", _I)
PII_STORAGE = [
    (r"\.save\s*\(|\.persist\s*\(|insertOne\s*\(", "persistence"),
    (r"putObject\s*\(", "s3"),
    (r"sendEmail|messages\.create|mail\.send", "third-party-comms"),
]

SQL_LITERAL = re.compile(r"[\"']([^\"'\n]{0,200}?\b(?:SELECT\b|INSERT\s+INTO\b|DELETE\s+FROM\b|UPDATE\s+\w{1,64}\s+SET\b|MERGE\s+INTO\b|UPSERT\b|CREATE\s+TABLE\b|TRUNCATE\s+TABLE\b|ALTER\s+TABLE\b)[^\"'\n]{0,400})", _I)
SQL_IMPORT = re.compile(r"\b(?:java\.sql|javax\.sql|jakarta\.persistence|javax\.persistence|org\.springframework\.jdbc|org\.springframework\.data|org\.hibernate|org\.jooq|mybatis|jakarta\.jdo|sqlalchemy|psycopg2?|pymysql|sqlite3|asyncpg|aiomysql|pyodbc|database/sql|gorm\.io|jmoiron/sqlx|knex|typeorm|sequelize|pg-promise|better-sqlite3)\b")
SQL_PLACEHOLDER = re.compile(r"\?|:[A-Za-z_]\w{0,63}|%\(?[a-z_]*\)?s|\$\d{1,3}")
QUOTED = re.compile(r'"[^"\n]{0,400}"|\'[^\'\n]{0,400}\'')
SQL_WORDS = r"(?:SELECT|INSERT|UPDATE|DELETE)"
INTERPOLATION = r"(?:\$\{[^}\n]{1,120}\}|\$[A-Za-z_]\w{0,63}|%\(?[A-Za-z_]{0,63}\)?[sd]|\{[A-Za-z_0-9]{0,63}\})"
LONGEST_LITERAL = 400

#: Constants that name a route.
PATH_CONSTANT = re.compile(r"\b([A-Za-z_][A-Za-z0-9_]{0,63})\s*(?::\s*[A-Za-z_][A-Za-z0-9_<>\[\].,? ]{0,63})?\s*(?::?=)\s*[\"'](/[A-Za-z0-9_][A-Za-z0-9_./\-{}]{0,200})[\"']")
PATH_ENUM = re.compile(r"\b([A-Z][A-Z0-9_]{1,63})\s*\(\s*[\"'](/[A-Za-z0-9_][A-Za-z0-9_./\-{}]{0,200})[\"']")
ENDPOINT_NAME = re.compile(r"PATH|URL|URI|ENDPOINT|ROUTE|_API|API_|RESOURCE", _I)
FILE_PATH = re.compile(r"/[^/]*\.[A-Za-z0-9]{1,6}$")

# Configuration files.
SECURITY_KEYS = re.compile(
    r"^\s*(security\.enabled|micronaut\.security\.enabled|enable\.serverauth|csrf\.disabled|csrf\.enabled|server\.ssl\.enabled|tls\.enabled|verify[-_.]?ssl|insecure[_-]?skip[_-]?verify|cors\.allowed[\.-]origins|cors\.allow[\.-]?credentials|management\.endpoints\.web\.exposure\.include|spring\.security\.user\.password|jwt\.secret|jwt\.signing[\.-]?key|oauth2?\.client[\.-]?secret|actuator\.endpoints|debug\s*[:=]\s*true)",
    _I | _M,
)
YAML_SECURITY_KEYS = re.compile(r"^\s*(?:password|secret|signing[-_]?algorithm|client[-_]?secret|csrf\.(?:enabled|disabled)|allowed[-_]?origins|allow[-_]?credentials)\s*:", _I | _M)
DATASOURCE_KEY = re.compile(r"(?:spring\.datasource\.url|datasource\.url|quarkus\.datasource\.jdbc\.url|micronaut\.datasources\.[^.\s]+\.url)\s*[=:]\s*['\"]?([^\"'\n]+)", _I)
STORE_URIS = [
    (re.compile(r"jdbc:(?:postgresql|mysql|mariadb|oracle|sqlserver|h2|sqlite)[^\"'\s]{8,}", _I), "jdbc"),
    (re.compile(r"mongodb(?:\+srv)?://[^\"'\s]{8,}", _I), "mongodb"),
    (re.compile(r"rediss?://[^\"'\s]{4,}", _I), "redis"),
]
S3_BUCKET = re.compile(r"(?:s3://([a-z0-9.\-]{3,63})|bucket[-_.]?name\s*[=:]\s*['\"]?([a-z0-9.\-]{3,63}))", _I)
CRYPTO_CONFIG = [
    (re.compile(r"server\.ssl\.ciphers?\s*[=:]", _I), "tls-cipher-suite"),
    (re.compile(r"encryption\.algorithm\s*[=:]", _I), "encryption-algorithm"),
    (re.compile(r"crypto\.algorithm\s*[=:]", _I), "encryption-algorithm"),
    (re.compile(r"jwt\.signing[-_.]?algorithm\s*[=:]", _I), "jwt-algorithm"),
    (re.compile(r"spring\.ssl\.bundle", _I), "tls-bundle"),
    (re.compile(r"^\s*ciphers\s*:", _I | _M), "tls-cipher-suite"),
    (re.compile(r"^\s*signing[-_]?algorithm\s*:", _I | _M), "jwt-algorithm"),
]
SECRET_REFS = [
    (re.compile(r"aws\.secretsmanager|secretsmanager:", _I), "aws-secrets-manager"),
    (re.compile(r"vault[:\.]|hashicorp\.vault", _I), "hashicorp-vault"),
    (re.compile(r"azure\.keyvault|keyvault\.vault", _I), "azure-key-vault"),
    (re.compile(r"secretmanager\.googleapis|gcp\.secret", _I), "gcp-secret-manager"),
    (re.compile(r"kms\.key|aws\.kms|alias/", _I), "aws-kms"),
]

#: Names of calls that run a script.
SCRIPT_CALLS = ("eval", "exec", "compile")
