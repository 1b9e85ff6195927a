"""Names under which one product is listed."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Search term, product names.
ALIASES = {
    "nginx": ["nginx", "nginx_open_source", "nginx_open_source_subscription"],
    "openssl": ["openssl"],
    "httpd": ["httpd", "http_server"],
    "http_server": ["httpd", "http_server"],
    "tomcat": ["tomcat"],
    "curl": ["curl", "libcurl"],
    "varnish": ["varnish", "varnish_cache"],
    "java": ["jre", "jdk"],
    "jre": ["jre", "jdk"],
    "jdk": ["jre", "jdk"],
    "acrobat": ["acrobat", "acrobat_dc", "acrobat_reader", "acrobat_reader_dc"],
    "acrobat_reader": ["acrobat", "acrobat_dc", "acrobat_reader", "acrobat_reader_dc"],
    "opera": ["opera", "opera_browser"],
    "macos": ["macos", "mac_os_x"],
    "mac_os_x": ["macos", "mac_os_x"],
    "joomla": ["joomla", "joomla!"],
    "docker": ["docker", "docker_desktop"],
    "spring": ["spring_framework"],
    "spring_framework": ["spring_framework"],
    "postgres": ["postgresql"],
    "k8s": ["kubernetes"],
}


def product_names(term: Column) -> Column:
    """Product names to search for a term; a term without aliases stands for itself."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.array(*map(F.lit, v))) for k, v in ALIASES.items()))
    return F.when(term.isNotNull(), F.coalesce(F.try_element_at(table, F.lower(term)), F.array(term)))
