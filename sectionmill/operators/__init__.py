"""Table jobs: sections, pages, records, manifest, corpus, audits."""
