"""Training cost formulas: FLOPs of 6 N T over a profile's throughput."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

LITERAL = "formula_txt_literal_total_parameters"


@dataclass(frozen=True)
class Profile:
    name: str = "h100"
    description: str = ""
    gpu_name: str = "NVIDIA H100"
    gpu_tflops: float = 989.0
    efficiency: float = 0.4
    gpu_hour_cost_usd: float = 1.85
    tokens_per_parameter: float = 20.0
    machines: int = 1
    gpus_per_machine: int = 8
    finetune_compute_fraction: float = 0.05
    diffusion_image_budget: float = 0.0
    latent_sequence_length: float = 0.0

    def check(self) -> None:
        positive = (self.gpu_tflops, self.efficiency, self.tokens_per_parameter, self.machines, self.gpus_per_machine)
        others = (self.gpu_hour_cost_usd, self.finetune_compute_fraction, self.diffusion_image_budget, self.latent_sequence_length)
        if not self.name or min(positive) <= 0 or self.efficiency > 1 or min(others) < 0 or self.finetune_compute_fraction > 1:
            raise ValueError(f"compute profile {self.name!r} has invalid settings")

    @property
    def prices_pictures(self) -> bool:
        return self.diffusion_image_budget > 0 and self.latent_sequence_length > 0


def gpu_hours(flops: Column, p: Profile) -> Column:
    return flops / F.lit(p.gpu_tflops * 1e12 * 3600 * p.efficiency)


def literal_flops(params: Column, kind: Column, p: Profile) -> Column:
    n = params.cast("double")
    return 6 * n * (p.tokens_per_parameter * n) * F.when(kind.isin("finetune", "adapter"), p.finetune_compute_fraction).otherwise(1.0)


def _active(params: Column, active_b: Column) -> tuple[Column, Column]:
    """(whether only some parameters are active for a token, the number that counts)."""
    n = params.cast("double")
    sparse = F.coalesce((active_b > 0) & (active_b * 1e9 < n), F.lit(False))
    return sparse, F.when(sparse, active_b * 1e9).otherwise(n)


def evidence(params: Column, active_b: Column, tokens_t: Column, p: Profile) -> tuple[Column, Column]:
    """(FLOPs, method) of a base model: activated parameters and reported tokens where known, totals otherwise."""
    sparse, n = _active(params, active_b)
    told = F.coalesce(tokens_t > 0, F.lit(False))
    flops = 6 * n * F.when(told, tokens_t * 1e12).otherwise(p.tokens_per_parameter * params.cast("double"))
    method = (
        F.when(told & sparse, "reported_pretraining_tokens_active_parameters")
        .when(told, "reported_pretraining_tokens_total_parameters")
        .when(sparse, "formula_txt_moe_active_parameter_scaling")
        .otherwise("formula_txt_parameter_scaling")
    )
    return flops, method


def pictures(params: Column, active_b: Column, p: Profile) -> tuple[Column, Column]:
    """(FLOPs, method) of a diffusion base model, from the profile's assumed budget of images."""
    sparse, n = _active(params, active_b)
    flops = 6 * n * (params.cast("double") * (p.diffusion_image_budget * p.latent_sequence_length))
    kind = F.when(sparse, "active").otherwise("total")
    return flops, F.concat(F.lit("formula_txt_diffusion_image_budget_"), kind, F.lit("_parameters"))


def wall_days(hours: Column, p: Profile) -> Column:
    return hours / (p.machines * p.gpus_per_machine) / 24


def cost(hours: Column, p: Profile) -> Column:
    return hours * p.gpu_hour_cost_usd


def estimate(flops: Column, method: Column | str, p: Profile) -> Column:
    """One priced estimate as a struct."""
    hours = gpu_hours(flops, p)
    method = F.lit(method) if isinstance(method, str) else method
    return F.struct(F.lit(p.name).alias("profile"), hours.alias("gpu_hours"), wall_days(hours, p).alias("wall_days"), cost(hours,
        p).alias("cost_usd"), method.alias("method"))
