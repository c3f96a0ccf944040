"""What each finding means: code (or family with *), usual severity, text. Scopes and options may change severities."""

from __future__ import annotations

_ROWS = """
route-not-fetched|info|No capture of the route exists.
robots-blocked|info|Robots rules keep the route from being fetched.
incomplete-fetch|error|The capture did not complete.
missing-http-response|error|The capture has no HTTP status.
server-error|error|The server answered with HTTP.
not-found|error|The route answered with HTTP.
unexpected-status|warning|The route answered with HTTP.
redirected-route|warning|The route redirects.
non-html-route|info|The route is not an HTML page.
missing-title|error|The page has no title.
missing-description|warning|The page has no description.
missing-canonical|error|The page has no canonical address.
missing-h1|warning|The page has no main heading.
multiple-h1|warning|The page has several main headings.
noindex|info|The page asks not to be indexed.
missing-og-title|error|The page has no og:title.
missing-og-description|warning|The page has no og:description.
missing-og-image|warning|The page has no og:image.
empty-ssr-shell|warning|The served HTML holds almost no content.
rendered-capture-incomplete|warning|The rendered capture did not complete.
rendered-status-mismatch|warning|Raw and rendered statuses differ.
client-only-content|error|The content appears only after rendering.
rendered-only-title|error|The title appears only after rendering.
rendered-only-canonical|error|The canonical address appears only after rendering.
rendered-only-h1|warning|The main heading appears only after rendering.
rendered-only-json-ld|warning|Structured data appears only after rendering.
rendered-only-og|warning|Social tags appear only after rendering.
invalid-hreflang|warning|Not a language code.
duplicate-hreflang|warning|Language given more than once.
invalid-json-ld|warning|A structured data block cannot be read.
json-ld-missing-context|warning|A structured data block has no context.
json-ld-missing-type|warning|A structured data block has no type.
duplicate-json-ld|warning|A structured data block is repeated.
conflicting-json-ld-id|warning|Blocks differ for the id.
agent-incomplete-fetch|error|Incomplete capture for a further agent than for the first.
agent-fetch-mismatch|warning|Another outcome of the fetch for a further agent than for the first.
agent-status-mismatch|warning|Another status for a further agent than for the first.
agent-redirect-mismatch|warning|Other redirects for a further agent than for the first.
agent-content-type-mismatch|warning|Another content type for a further agent than for the first.
agent-title-mismatch|warning|Another title for a further agent than for the first.
agent-description-mismatch|warning|Another description for a further agent than for the first.
agent-canonical-mismatch|warning|Another canonical address for a further agent than for the first.
agent-robots-mismatch|warning|Other robots directives for a further agent than for the first.
deep-route|warning|The page is many links away from the start.
orphan-route|warning|No path of links leads to the page.
dead-end-route|info|The page links to no other.
not-in-sitemap|warning|No sitemap lists the page.
sitemap-redirect|error|A sitemap lists a redirect.
sitemap-broken-url|error|A sitemap lists a broken page.
sitemap-noindex|error|A sitemap lists a page kept from the index.
sitemap-robots-blocked|error|A sitemap lists a page that robots rules block.
non-self-canonical|warning|The canonical address is another page.
broken-canonical-target|error|The canonical target is broken.
redirecting-canonical-target|warning|The canonical target redirects.
noindex-canonical-target|error|The canonical target is kept from the index.
broken-internal-link|error|A link leads to HTTP.
redirecting-internal-link|warning|A link leads to a redirect.
internal-link-to-noindex|warning|A link leads to a page kept from the index.
hreflang-target-noindex|error|A language alternate is kept from the index.
hreflang-missing-return-link|warning|A language alternate does not lead back.
slow-route|warning|The page answered slowly.
slow-redirect|warning|A redirect answered slowly.
soft-404|error|The page equals a captured not-found page.
possible-soft-404|warning|The page nearly equals a captured not-found page.
crawl-policy|info|Robots rules set the pace of the crawl.
page-budget-reached|warning|The crawl stopped at its budget.
canonical-target-unseen|warning|The canonical target is not among the routes (info after a truncated crawl).
hreflang-target-unseen|warning|A language alternate is not among the routes (info after a truncated crawl).
duplicate-canonical-target|warning|Several pages share a canonical address.
duplicate-title-across-routes|warning|Several pages share a title.
duplicate-description-across-routes|warning|Several pages share a description.
duplicate-content-across-routes|warning|Several pages have the same content.
route-case-or-slash-variant|warning|Addresses differ only by case or a trailing slash.
duplicate-*|warning|The page repeats a value that should stand once.
conflicting-*|warning|The page has several unlike values where one is expected.
sitemap-warning|warning|A sitemap could not be read as meant.
robots-warning|warning|The robots file could not be read as meant.
next-discovery-warning|warning|A build manifest could not be read as meant.
next-dynamic-route-needs-sample|info|A dynamic route of the build has no sample address.
redirect-contract-unchecked|warning|The source of a redirect contract was not captured.
expected-redirect-missing|error|The source of a redirect contract does not redirect.
redirect-status-mismatch|error|The first redirect has another status than its contract.
redirect-target-mismatch|error|The redirects end at another address than the contract names.
redirect-chain|warning|More redirects than the contract allows.
redirect-target-unhealthy|error|The target of a redirect contract is broken or kept from the index.
redirect-pattern-unmatched|info|A redirect pattern matched no address.
"""
RULES: list[tuple[str, str, str]] = [tuple(line.split("|", 2)) for line in _ROWS.strip().splitlines()]
