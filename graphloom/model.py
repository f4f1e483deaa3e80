"""Vocabulary and named constants of the evidence graph (fixed values)."""

TIER_WEIGHT = {"curated_db": 0.9, "peer_reviewed": 0.7, "review": 0.5, "preprint": 0.4, "llm_inferred": 0.3, "patient_reported": 0.2, "computed": 0.79}
FAMILIES = {
    "dna": ["caused_by_variant_in", "acts_via", "participates_in", "variant_of", "observed_in", "same_gene_same_mechanism", "same_gene_different_mechanism", "shared_pathway", "shared_gene", "near_on_chromosome"],
    "symptoms": ["has_phenotype", "similar_symptoms", "candidate_phenotype", "suggested_by_neighbour"],
    "research": ["asserts", "authored", "pi_of", "funds_research_on", "shared_researcher", "about"],
    "community": ["serves", "runs", "studies", "investigator_of", "affiliated_with", "member_of"],
}
SYMMETRIC = ["same_gene_same_mechanism", "same_gene_different_mechanism", "shared_pathway", "similar_symptoms", "shared_researcher", "shared_gene", "near_on_chromosome"]
ORIGINS = ["observed", "inferred", "patient_reported", "user_contributed"]
SUPPORTED, CONTRADICTION, HIGH, MEDIUM = 0.6, 0.1, 0.8, 0.5
INFERRED_CAP, NEAR_CAP, CANDIDATE_CAP = 0.79, 0.45, 0.55
