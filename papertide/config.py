"""Settings of the analytics engine.  Credentials come from the environment and have no default."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

# Terms of the corpus search.
SEARCH_TERMS = (
    "artificial intelligence",
    "machine learning",
    "deep learning",
    "DL",
    "AI",
    "neural network",
    "convolutional neural network",
    "transformer",
    "large language model",
    "foundation model",
    "generative",
    "computer-aided",
    "automated segmentation",
    "self-supervised",
    "natural language processing",
    "chatgpt",
    "gpt-4",
)

# Category labels and the substrings that assign them.
TAXONOMY: dict[str, tuple[str, ...]] = {
    "Large language models / NLP": ("large language model", "llm", "chatgpt", "gpt-4", "gpt-3", "bert", "natural language processing", "nlp", "report generation", "chatbot", "text", "prompt"),
    "Generative / diffusion models": ("generative adversarial", "gan", "diffusion model", "synthesis", "image generation", "denoising diffusion", "variational autoencoder"),
    "Multimodal AI": ("multimodal", "multi-modal", "vision-language", "image-text", "clinical-imaging fusion", "multimodal fusion"),
    "Image segmentation": ("segmentation", "u-net", "unet", "nnu-net", "lesion segmentation", "tumor segmentation", "auto-segmentation"),
    "Detection / classification (CADx)": ("detection", "classification", "computer-aided", "diagnosis", "triage", "screening", "lesion detection"),
    "Image reconstruction / acceleration": ("reconstruction", "accelerated", "denoising", "super-resolution", "compressed sensing", "deep learning reconstruction", "undersampled"),
    "Quantitative imaging": ("texture analysis", "quantitative imaging", "handcrafted features", "feature extraction"),
    "Prognosis / outcome prediction": ("outcome prediction", "prognosis", "survival", "risk prediction", "treatment response", "recurrence"),
    "Reinforcement learning": ("reinforcement learning", "q-learning", "policy gradient", "reward"),
    "AI agents / autonomous systems": ("ai agent", "autonomous agent", "agentic", "tool use", "multi-agent"),
    "Foundation models / self-supervised": ("foundation model", "self-supervised", "pretrained", "pretraining", "transfer learning", "contrastive learning"),
    "Federated / privacy-preserving learning": ("federated learning", "privacy-preserving", "differential privacy"),
    "Explainability / trustworthy AI": ("explainable", "interpretability", "saliency", "grad-cam", "uncertainty", "calibration", "trustworthy"),
}

# The closed vocabularies of an annotation.
CLINICAL_TASKS = ("detection", "diagnosis_classification", "segmentation", "image_reconstruction", "prognosis_outcome", "image_generation", "report_generation_nlp", "workflow_triage", "quality_other", "not_applicable")
MODEL_FAMILIES = ("cnn", "vision_transformer", "transformer_llm", "rnn", "gan", "diffusion", "graph_nn", "classical_ml", "radiomics", "foundation_model", "other")
DATA_REGIMES = ("single_center", "multi_center", "public_dataset", "mixed", "unknown")

# What the older single-script version searched titles and descriptions for.
LEGACY_TERMS = ("artificial intelligence", "machine learning", "deep learning", "radiomics", "transformer", "chatgpt", "large language model", "foundation model", "neural network", "convolutional neural network", "cnn", "llm")


@dataclass(frozen=True)
class ApiSettings:
    """The citation database's REST interface; whoever uses it names its address."""

    base_url: str = ""
    page_size: int = 25
    pause_s: float = 0.15
    attempts: int = 4
    timeout_s: float = 30.0

    def key(self) -> str:
        """From the environment; a KeyError says which variable is missing."""
        return os.environ["CITATION_API_KEY"]


@dataclass(frozen=True)
class ClusterSettings:
    neighbours: int = 15
    components: int = 5
    min_cluster_size: int = 5
    top_terms: int = 12
    seed: int = 42


@dataclass(frozen=True)
class Settings:
    """``as_of_year`` replaces the wall clock, so that results do not depend on when they are computed."""

    as_of_year: int
    issn: str = "0195-6108"
    years_back: int = 10
    search_terms: tuple[str, ...] = SEARCH_TERMS
    taxonomy: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(TAXONOMY))
    label_mode: str = "union"
    api: ApiSettings = ApiSettings()
    cluster: ClusterSettings = ClusterSettings()
